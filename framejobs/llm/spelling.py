"""Spelling variants by finite-state composition.

The vocabulary's words are accepted by a minimised acyclic acceptor A. The composition A ∘ E ∘ A with the one-edit transducer E (copies letters, and
once inserts, deletes or replaces one) accepts exactly the pairs of near words. It is cut by its initial states. Take the shorter word's first half and
second half: the one that the edit does not touch is the same in both words, so each half, with its place, is an initial state of its own, and the
acceptor from there on has the words that share it. A word enters four of them: two halves, and both again for the words that are a letter longer.
Tasks hold many initial states; all of a task's acceptors share one register of states, so equal remainders are one state, and what a pair of states
accepts in common is found once. Pairs with one initial state on both sides are listed state by state.

An initial state with more words than a task should list is cut again: its open half is halved, and each quarter is closed in turn, until few words
are left or one letter is open, which fits a bounded number of words. So a beginning that a third of all words share is no task of its own, and
nothing is left out. A pair is listed where its first difference lies in the open part, thus once.

Defined results: a null text has no words; a null doc_id is the empty string in the text whose hash moves a letter; documents with one id are read
each; ties go to the smaller word in code-point order; an empty table gives an empty result; of other columns none is read.
"""

from __future__ import annotations

import string

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framejobs.llm._joins import join_frequent
from framejobs.llm._session import with_checkpoints

LETTERS, LEAST_LENGTH, LEAST_COUNT, RATIO, ONE_IN = "A-Za-zÀ-ÿ", 6, 5, 5, 199
#: Words of an initial state that a task lists at once; rows of a result batch.
CROWD, ROWS = 4_000, 20_000
STATE = ["short", "a", "b", "head", "tail"]


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", one_in: int = ONE_IN, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): runs of letters, lower-cased from A to Z, with at least ``least_length`` letters and ``least_count`` occurrences. Of about one
    occurrence in ``one_in``, by its hash, one letter is left out."""
    runs = F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    runs = runs.withColumn("run", F.translate("run", string.ascii_uppercase, string.ascii_lowercase))
    h = F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8"))
    at = F.pmod(h, F.char_length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    words = runs.select(F.when(h % one_in == 0, short).otherwise(F.col("run")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.filter((F.col("n") >= least_count) & (F.char_length("word") >= least_length))


def _entries(words: DataFrame) -> DataFrame:
    """Words at their first initial states: for words of the lengths ``short`` and one more, all but the letters from a to b."""
    n = F.char_length("word")
    sized = words.withColumn("short", F.explode(F.array(n, n - 1)))
    half = F.floor(F.col("short") / 2).cast("int")
    return _closed(sized.withColumn("open", F.explode(F.array(F.struct(F.lit(0).alias("a"), half.alias("b")), F.struct(half.alias("a"), F.col("short").alias("b"))))))


def _halved(crowded: DataFrame) -> DataFrame:
    """Words at the two initial states that halve their open part."""
    mid = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    return _closed(crowded.select("word", "n", "short", F.explode(F.array(F.struct("a", mid.alias("b")), F.struct(mid.alias("a"), "b"))).alias("open")))


def _closed(df: DataFrame) -> DataFrame:
    a, rest = F.col("open.a"), F.col("short") - F.col("open.b")
    return df.select(
        "word", "n", "short", a.alias("a"), F.col("open.b").alias("b"), F.substring(F.col("word"), F.lit(1), a).alias("head"),
        F.substring(F.col("word"), F.char_length("word") - rest + 1, rest).alias("tail"),
    )


class Acceptor:
    """Minimised acyclic acceptors of sorted word lists, with one register of states. A state is a number; ``arcs`` has its (letter, state) pairs in
    order, ``final`` whether a word ends there."""

    def __init__(self):
        self.register: dict[tuple, int] = {}
        self.arcs: list[tuple] = []
        self.final: list[bool] = []
        self.common: dict[tuple[int, int], list[str]] = {}

    def state(self, final: bool, arcs: tuple) -> int:
        key = (final, arcs)
        if key not in self.register:
            self.register[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
        return self.register[key]

    def add(self, words: list[str]) -> int:
        """The initial state of the acceptor of some words in ascending order: states are closed from the end of each word as soon as the next word
        leaves them."""
        path: list[list] = [[False, []]]  # the states of the last word: final, arcs so far
        letters: list[str] = []
        for word in words:
            same = 0
            while same < len(letters) and same < len(word) and letters[same] == word[same]:
                same += 1
            self._close(path, letters, same)
            for c in word[same:]:
                letters.append(c)
                path.append([False, []])
            path[-1][0] = True
        self._close(path, letters, 0)
        return self.state(path[0][0], tuple(path[0][1]))

    def _close(self, path: list, letters: list[str], keep: int) -> None:
        while len(letters) > keep:
            final, arcs = path.pop()
            path[-1][1].append((letters.pop(), self.state(final, tuple(arcs))))

    def both(self, p: int, q: int) -> list[str]:
        """What two states both accept."""
        found = self.common.get((p, q))
        if found is None:
            found, stack = [], [(p, q, "")]
            while stack:
                x, y, s = stack.pop()
                if self.final[x] and self.final[y]:
                    found.append(s)
                to = self.arcs[x] if x == y else dict(self.arcs[y])
                stack += [(i, i, s + c) for c, i in to] if x == y else [(i, to[c], s + c) for c, i in self.arcs[x] if c in to]
            self.common[p, q] = found
        return found

    def pairs(self, start: int, size: int, end: int):
        """The words from a state that differ by one edit, one of them with ``size`` letters and the other with as many or one more, each pair once:
        letters are copied up to the first difference, at place ``end`` at most, and after the edit again."""
        stack = [(start, "")]
        while stack:
            p, s = stack.pop()
            arcs = self.arcs[p]
            if len(s) < end:
                stack += [(i, s + c) for c, i in arcs]
            for k, (c, i) in enumerate(arcs):
                for d, j in arcs[k + 1 :]:
                    for rest in self.both(i, j):  # replaced: s c rest, s d rest; longer ones are listed at another initial state
                        if len(s) + 1 + len(rest) == size:
                            yield s + c + rest, s + d + rest
                if self.final[p] and self.final[i]:
                    yield s, s + c  # inserted at the end
                for d, j in self.arcs[i]:  # inserted c before another letter d: s d rest, s c d rest
                    if d != c and (to := dict(arcs).get(d)) is not None:
                        for rest in self.both(to, j):
                            yield s + d + rest, s + c + d + rest


def _near_pairs(entries: DataFrame) -> DataFrame:
    """(x, y, n_x, n_y), each pair of near words once, of words at initial states that are not crowded."""

    def run(batches):
        machine, out = Acceptor(), []
        here, words = None, []

        def listed():
            nonlocal machine
            short, a, b, head, tail = here
            if len(words) > 1 and any(len(w) == short for w, _ in words):
                cut = len(tail)
                inner = [(w[a : len(w) - cut], w, n) for w, n in words]
                inner.sort()
                by = {s: (w, n) for s, w, n in inner}
                # The first difference is at a place of the open part; a letter may also come after the last one of the word.
                for s, t in machine.pairs(machine.add([s for s, _, _ in inner]), b - a, b - a if b == short else b - a - 1):
                    (x, n_x), (y, n_y) = by[s], by[t]
                    yield x, y, n_x, n_y
                if len(machine.arcs) > 500_000 or len(machine.common) > 200_000:
                    machine = Acceptor()

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["x", "y", "n_x", "n_y"])

        for batch in batches:
            for *state, word, n in zip(*(batch.column(c).to_pylist() for c in (*STATE, "word", "n")), strict=True):
                if state != here:
                    if here:
                        out += listed()
                        if len(out) >= ROWS:
                            yield table(out)
                            out = []
                    here, words = state, []
                words.append((word, n))
        if here:
            out += listed()
        if out:
            yield table(out)

    # Dealt by a hash of its own: after a join by the same columns Spark would leave out a repartition by them and the sort, and then, when it runs,
    # might turn that join into one that neither deals nor sorts.
    dealt = entries.withColumn("state", F.xxhash64(*STATE)).repartition("state").sortWithinPartitions(*STATE).drop("state")
    return dealt.mapInArrow(run, "x string, y string, n_x long, n_y long")


def near_words(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(x, y, n_x, n_y): all pairs of words of a vocabulary (word, n) that differ by one inserted, deleted or replaced letter, each once. The words have
    two letters at least."""
    found, entries = [], _entries(words)
    while True:
        sizes = entries.groupBy(*STATE).agg(F.count("*").alias("rows"))
        crowded = sizes.filter((F.col("rows") > crowd) & (F.col("b") - F.col("a") > 1)).checkpoint()
        if crowded.isEmpty():
            found.append(_near_pairs(entries))
            break
        total = crowded.agg(F.sum("rows")).first()[0]
        again = _halved(join_frequent(entries, crowded, STATE, "rows", total).drop("rows")).checkpoint()
        found.append(_near_pairs(entries.join(crowded.drop("rows"), STATE, "left_anti")))
        entries = again
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def spelling_variants(words: DataFrame, ratio: int = RATIO, crowd: int = CROWD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of a vocabulary (word, n): its near word of largest n, if that is at least ``ratio`` times
    the word's; where forms lead in the end; how many words are near."""
    with_checkpoints(words.sparkSession)
    words = words.select("word", "n").checkpoint()
    pairs = near_words(words, crowd)
    each = pairs.select(F.explode(F.array(F.struct(F.col("x").alias("word"), F.col("y").alias("near"), F.col("n_y").alias("m")), F.struct(F.col("y").alias("word"), F.col("x").alias("near"), F.col("n_x").alias("m")))).alias("p")).select("p.*")
    best = each.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("best"))
    led = words.join(best, "word", "left").withColumn("form", F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best.near")))
    led = led.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form", F.when(F.col("form").isNotNull(), -F.col("best.less")).alias("form_n")).checkpoint()

    # Counts grow along forms by the ratio, so chains are short; each round doubles the step. Words at their end stay, as others lead to them.
    steps = led.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = steps.join(onward, "root", "left").checkpoint()
        if steps.filter("next is not null").isEmpty():
            break
        steps = steps.select("word", F.coalesce("next", "root").alias("root"))
    roots = steps.select("word", "root")
    return led.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return spelling_variants(vocabulary(with_checkpoints(spark).read.parquet(f"{sf_dir}/documents.parquet")))


HEX = "0123456789ABCDEF"
OP11_SQL = f"""with recursive tab as (select list(v order by i) as t from (select i, list_reduce(list_prepend(i::bigint, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
  lambda p, z: case when p & 1 = 1 then xor(p >> 1, 3988292384) else p >> 1 end) as v from range(256) r(i))),
runs as (select coalesce(doc_id::varchar, '') as id, translate(unnest(regexp_extract_all(text, '[{LETTERS}]{{{LEAST_LENGTH},}}')), '{string.ascii_uppercase}', '{string.ascii_lowercase}') as run from documents),
g as (select id, run, count(*) as k, hex(encode(id || ':' || run)) as x from runs group by 1, 2),
c as (select run, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2), lambda i: (strpos('{HEX}', substr(x, 2 * i + 1, 1)) - 1) * 16 + strpos('{HEX}', substr(x, 2 * i + 2, 1)) - 1)),
  lambda a, v: xor(a >> 8, t[(xor(a, v) & 255) + 1])), 4294967295) as h from g, tab),
w as (select case when h % {ONE_IN} = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, sum(k)::bigint as n from c group by 1),
v as materialized (select * from w where n >= {LEAST_COUNT} and length(word) >= {LEAST_LENGTH}),
d as materialized (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as cut from (select word, n, unnest(range(1, length(word) + 1)) as i from v)),
p as materialized (select a.word, b.word as near, b.n as m from d a join d b on a.i = b.i and a.cut = b.cut and a.word <> b.word
  union select d.word, v.word, v.n from d join v on d.cut = v.word union select v.word, d.word, d.n from d join v on d.cut = v.word),
f as materialized (select v.word, v.n, count(near) as n_near, arg_min(near, (-m, near)) as best, max(m) as m from v left join p on p.word = v.word group by 1, 2),
l as materialized (select word, n, n_near, case when m >= {RATIO} * n then best end as form, case when m >= {RATIO} * n then m end as form_n from f),
r(word, root) as (select word, word from l union all select r.word, l.form from r join l on l.word = r.root where l.form is not null)
select l.word, l.form, r.root, l.n, l.n_near, l.form_n from l join r on r.word = l.word join l e on e.word = r.root and e.form is null"""
