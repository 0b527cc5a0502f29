"""Spelling variants: finite-state composition of the vocabulary, a one-edit transducer and the vocabulary again."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import discard, documents, map_batches, materialise

#: Letters of a word; only A-Z have their case folded.
LETTERS = "[A-Za-zÀ-ÿ]"
#: Fewest code points of a word.
SHORTEST = 7
#: Most words of a partition, where its words still differ in more than three places.
MOST_WORDS = 2048
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, run): every maximal run of letters of at least `shortest` code points, A-Z lower-cased."""
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"{LETTERS}{{{shortest},}}"), F.lit(0))
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(runs).alias("run")).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))


def with_slips(run: Column, doc_id: Column, one_in: int) -> Column:
    """The run, or for one in so many (by the CRC of `<doc_id>:<run>`) the run without one code point. A null doc_id
    leaves runs alone."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % one_in == 0, cut).otherwise(run)


def vocabulary(words: DataFrame, shortest: int = SHORTEST, fewest: int = 2) -> DataFrame:
    """(word, n): distinct values of the column word of at least so many code points and occurrences."""
    counts = words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= fewest)


def minimal_acceptor(words: list[str]) -> tuple[list[dict[str, int]], list[bool], int]:
    """The smallest deterministic acceptor of sorted distinct words: arcs and finality by state, and the initial state.

    States that stand on the last word's way are open; behind the point where the next word leaves it they are closed,
    that is merged with a state of the same finality and arcs if there is one."""
    arcs: list[dict[str, int]] = []
    final: list[bool] = []
    closed: dict[tuple, int] = {}
    way: list[tuple[str, dict[str, int], list[bool]]] = [("", {}, [False])]  # letter that leads here, arcs, finality

    def close(depth: int) -> int:
        state = -1
        while len(way) > depth:
            letter, out, ends = way.pop()
            key = (ends[0], *out.items())
            state = closed.setdefault(key, len(arcs))
            if state == len(arcs):
                arcs.append(out)
                final.append(ends[0])
            if way:
                way[-1][1][letter] = state
        return state

    last = ""
    for word in words:
        same = 0
        for x, y in zip(last, word):
            if x != y:
                break
            same += 1
        close(same + 1)
        way.extend((c, {}, [False]) for c in word[same:])
        way[-1][2][0] = True
        last = word
    return arcs, final, close(0)


def one_edit_pairs(words: list[str], most: int) -> Iterator[tuple[str, str]]:
    """Accepted pairs of acceptor o one-edit transducer o acceptor, each once, whose first difference is among the
    first `most` places.

    Before the edit both sides have read the same, so they are in one state p of the acceptor and the composition's
    states are (p, no edit, p). There the transducer may replace x by y, which leads to (arc x, edited, arc y), or
    insert y, which leads to (p, edited, arc y). After the edit it copies only: what is left of both words is in the
    intersection of the two states' languages, which is kept for each pair of states; minimal acceptors have few.
    An inserted letter is never the one that follows it, so an insertion into a run of it counts once. Removing a
    letter is the same pair seen from its other side."""
    arcs, final, start = minimal_acceptor(words)
    shared: dict[tuple[int, int], list[str]] = {}

    def common(p: int, q: int) -> list[str]:
        key = (p, q) if p < q else (q, p)
        if (found := shared.get(key)) is None:
            found, todo = [], [(*key, "")]
            while todo:
                p, q, tail = todo.pop()
                if final[p] and final[q]:
                    found.append(tail)
                a, b = arcs[p], arcs[q]
                if len(b) < len(a):
                    a, b = b, a
                todo += [(s, b[c], tail + c) for c, s in a.items() if c in b]
            shared[key] = found
        return found

    todo = [(start, "")]
    while todo:
        p, head = todo.pop()
        out = [*arcs[p].items()]
        for i, (y, q) in enumerate(out):
            for x, r in out[:i]:
                for tail in common(r, q):
                    yield head + x + tail, head + y + tail
            for tail in common(p, q):
                if tail[:1] != y:
                    yield head + tail, head + y + tail
        if len(head) + 1 < most:
            todo += [(q, head + y) for y, q in out]


def _parts(words: DataFrame) -> DataFrame:
    """(word, n, half, a, b, most, front, back): each word under the initial and final states of its partitions.

    Words of half h have 2h to 2h + 2 code points. If two differ by one edit either their first h code points are the
    same, or their first difference is among those and their last h code points are the same."""
    size, half = F.length("word"), F.floor(F.length("word") / 2).cast("int")
    halves = F.when(size % 2 == 0, F.array(half, half - 1)).otherwise(F.array(half))
    rows = words.select("word", "n", F.explode(halves).alias("half"))
    sides = F.array(F.struct(F.col("half").alias("a"), F.lit(0).alias("b"), F.lit(1 << 30).alias("most")), F.struct(F.lit(0).alias("a"), F.col("half").alias("b"), F.col("half").alias("most")))
    return _keyed(rows.select("word", "n", "half", F.explode(sides).alias("s")).select("word", "n", "half", "s.*"))


def _keyed(rows: DataFrame) -> DataFrame:
    front = F.substring("word", F.lit(1), F.col("a"))
    return rows.withColumn("front", front).withColumn("back", F.substring("word", F.length("word") - F.col("b") + 1, F.col("b")))


PART = ["half", "a", "b", "most", "front", "back"]


def _refined(rows: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of other partitions, rows of `large` ones under narrower partitions): what may differ is cut in two."""
    middle = 2 * F.col("half") - F.col("a") - F.col("b")
    step = F.greatest(F.lit(1), F.floor(F.least("most", middle) / 2).cast("int"))
    sides = F.array(
        F.struct((F.col("a") + step).alias("a"), F.col("b").alias("b"), (F.col("most") - step).alias("most")),
        F.struct(F.col("a").alias("a"), (F.col("b") + middle - step).alias("b"), step.alias("most")),
    )
    inside = rows.join(large, PART, "left_semi").select("word", "n", "half", F.explode(sides).alias("s")).select("word", "n", "half", "s.*")
    return rows.join(large, PART, "left_anti"), _keyed(inside.where("most > 0"))


def near_words(words: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """(word, other, n_other): all ordered pairs of words (word, n) that differ by exactly one inserted, deleted or
    replaced code point. Words must be distinct and have at least two code points.

    A partition is an initial state of the composition: the words that go on from one beginning, or go to one end. It
    is composed on its own, so no task holds the whole acceptor. Partitions of more than `most_words` words are cut
    again by the next half of what may differ, until they are small or their words differ in three places at most."""
    rows, done = materialise(_parts(words), "spelling-parts"), None
    while True:
        large = rows.where("2 * half - a - b > 1").groupBy(*PART).agg(F.count("*").alias("c")).where(F.col("c") > most_words).drop("c")
        large = materialise(large, "spelling-large")
        some = not large.isEmpty()
        small, again = _refined(rows, large) if some else (rows, None)
        done = small if done is None else done.unionByName(small)
        if not some:
            break
        rows = materialise(again, "spelling-parts")
    bags = done.groupBy(*PART).agg(F.collect_list(F.struct("word", "n")).alias("words"), F.count("*").alias("c")).where("c > 1").select("half", "a", "b", "most", "words")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            left, right, count = [], [], []
            for half, a, b, most, bag in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
                names, sizes = bag.values.field("word").to_pylist(), bag.values.field("n").to_pylist()
                front, back = names[0][:a], names[0][len(names[0]) - b :]
                n = dict(zip(names, sizes))
                for x, y in one_edit_pairs(sorted(w[a : len(w) - b] for w in names), most):
                    x, y = front + x + back, front + y + back
                    if len(x) < 2 * half + 2 or len(y) < 2 * half + 2:  # else the pair belongs to the next half
                        left += [x, y]
                        right += [y, x]
                        count += [n[y], n[x]]
            return pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(count, pa.int64())], ["word", "other", "n_other"])

        return step

    found = materialise(map_batches(bags, make, "word string, other string, n_other long"), "near-words")
    discard(rows)
    return found


def spelling_variants(words: DataFrame, times: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of words (word, n): n_near is the number of other words one edit away; form
    the commonest of them (ties: first in code-point order) if it is at least `times` as common as the word, form_n its
    count; root what forms lead to in the end, the word itself without a form.

    times must be over 1: counts then rise from form to form, so ways end, and a way is at most log(largest count)
    long. Ways are followed by doubling. An empty vocabulary gives an empty result."""
    if times <= 1:
        raise ValueError("times must be over 1")
    words = materialise(words.select("word", "n"), "vocabulary")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("less"), F.col("other"))).alias("best"))
    near = near.select("word", "n_near", F.col("best.other").alias("other"), (-F.col("best.less")).alias("other_n"))
    strong = F.col("other_n") >= times * F.col("n")
    each = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(strong, F.col("other")).alias("form"), F.when(strong, F.col("other_n")).alias("form_n"))
    each = materialise(each, "spelling-forms")
    to = each.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        to = materialise(to.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if to.where("moved").isEmpty():
            break
        to = to.drop("moved")
    return each.join(to.select("word", "root"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_spelling_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of whole documents, one run in 31 with a slip. Null texts have none."""
    runs = text_runs(documents(spark, sf_dir))
    words = vocabulary(runs.select(with_slips(F.col("run"), F.col("doc_id"), 31).alias("word")))
    return spelling_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


OP12_SQL = r"""
with recursive bits as (select b, list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as x from (select unnest(range(256)) as b)),
crc as (select list(x order by b) as t from bits),
runs as (select doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}')) as r from documents) group by all),
coded as (select doc_id, run, n, hex(doc_id || ':' || run) as x from runs),
hashed as (select doc_id, run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::bigint)), lambda c, s: xor(c >> 8, t[(xor(c, s) & 255) + 1])), 4294967295) as h from coded, crc),
words as (select word, sum(n)::bigint as n from (select case when h % 31 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from hashed) where length(word) >= 7 group by word having sum(n) >= 2),
cut as (select word, n, i, left(word, i::int) as a, substr(word, i::int + 2) as b from (select word, n, unnest(range(length(word))) as i from words)),
pair as (
  select x.word, y.word as other, y.n as other_n from cut x join cut y on x.i = y.i and x.a = y.a and x.b = y.b and x.word <> y.word
  union select c.word, w.word, w.n from cut c join words w on w.word = c.a || c.b
  union select w.word, c.word, c.n from cut c join words w on w.word = c.a || c.b),
near as (select word, count(*) as n_near, max(other_n) as most from pair group by word),
best as (select word, n_near, most, min(other) as other from near join pair using (word) where other_n = most group by all),
each as (select word, n, coalesce(n_near, 0) as n_near, case when most >= 10 * n then other end as form, case when most >= 10 * n then most end as form_n from words left join best using (word)),
way as (select word, form as goal, 1 as k from each where form is not null union all select way.word, form, k + 1 from way join each on each.word = way.goal where form is not null),
root as (select word, arg_max(goal, k) as root from way group by word)
select word, form, coalesce(root, word) as root, n, n_near, form_n from each left join root using (word)
"""
