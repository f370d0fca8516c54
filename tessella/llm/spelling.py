"""Grouping of spelling variants with forward and backward minimal acyclic automata (operator 11).

Two words that differ by one inserted, deleted or replaced code point share either the first or
the second half of the one that is asked for.  So each word is looked up twice: a forward
automaton follows the first half exactly and completes the rest with one error; an automaton of
reversed words does the same from the other end.  Automata are minimal and acyclic, and count
the words below each state, which numbers the words perfectly: a path's number is the place of
its word, where its count is kept, and a word that several errors lead to is told by its number.
What the forward search finds begins with the first half; the backward search passes over such words,
so that none is found twice.

Words that can meet share the half as well: each word is dealt by the two first parts and the two
last parts by which words of its own length, or one more or less, can ask for it, and asks by its
own half.  A task holds the words of some halves.  The words of a half that has too many are dealt
over parts, and those that ask go to all of them.  Answers are a row for each word asked, never pairs.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import column, delete, materialize, new_path, small_batches, table

#: Latin-1 bytes of words, A-Z lower-cased; all other bytes end a word.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
#: Words of a task's partial counts before they are sent on, words of a task's automata (about), and words of one half that one task takes.
HELD, BUCKET_WORDS, PART_WORDS = 300_000, 40_000, 40_000


class Automaton:
    """The minimal acyclic automaton of words that come in order without repeats; state 0 is the start."""

    def __init__(self, words: list[str]) -> None:
        self.edges: list[dict[str, tuple[int, int]]] = [{}]  # letter: next state, and words that come before its words
        self.final = [False]
        size, known = [0], {}
        path, last = [({}, [False])], ""  # open states of the last word: children and whether a word ends there

        def settle(to: int) -> None:
            """Registers the open states beyond depth ``to``; equal ones become one."""
            for depth in range(len(path) - 1, to, -1):
                children, ends = path.pop()
                key = (ends[0], *children.items())
                state = known.get(key)
                if state is None:
                    state = known[key] = len(self.edges)
                    self._close(children, ends[0], size)
                path[-1][0][last[depth - 1]] = state

        for word in words:
            same, most = 0, min(len(word), len(last))
            while same < most and word[same] == last[same]:
                same += 1
            settle(same)
            path.extend(({}, [False]) for _ in range(len(word) - same))
            path[-1][1][0] = True
            last = word
        settle(0)
        children, ends = path[0]
        self._close(children, ends[0], size, 0)

    def _close(self, children: dict[str, int], final: bool, size: list[int], at: int | None = None) -> None:
        before, own = int(final), {}
        for letter, state in children.items():  # in order, as words came in order
            own[letter] = (state, before)
            before += size[state]
        if at is None:
            self.edges.append(own)
            self.final.append(final)
            size.append(before)
        else:
            self.edges[at], self.final[at], size[at] = own, final, before

    def near(self, word: str, exact: int) -> set[int]:
        """Numbers of the words that begin with ``word[:exact]`` and differ from ``word`` by one error."""
        edges, final = self.edges, self.final
        state, number = 0, 0
        for c in word[:exact]:
            step = edges[state].get(c)
            if step is None:
                return set()
            state = step[0]
            number += step[1]
        found: set[int] = set()

        def follow(state: int, number: int, rest: str) -> None:
            for c in rest:
                step = edges[state].get(c)
                if step is None:
                    return
                state = step[0]
                number += step[1]
            if final[state]:
                found.add(number)

        for i in range(exact, len(word) + 1):
            here, rest = edges[state], word[i:]
            if rest:
                c, after = rest[0], rest[1:]
                first, second = c, after[:1]
                follow(state, number, after)  # c is deleted
                for letter, (to, skip) in here.items():
                    onward = edges[to]
                    if first in onward:  # letter is inserted before c
                        follow(to, number + skip, rest)
                    if letter != c and (second in onward if second else final[to]):  # letter replaces c
                        follow(to, number + skip, after)
                step = here.get(c)
                if step is None:
                    break
                state = step[0]
                number += step[1]
            else:
                for to, skip in here.values():
                    if final[to]:
                        found.add(number + skip)
        return found


def _words(min_chars: int, typo: int):
    """Partial counts of the words of a task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                start = zlib.crc32(f"{'' if id_ is None else id_}:".encode())
                for run_, n in Counter(text.encode("latin-1", "replace").translate(TABLE).split()).items():
                    size = len(run_)
                    if size < min_chars:
                        continue
                    h = zlib.crc32(run_ if run_.isascii() else run_.decode("latin-1").encode(), start)
                    if typo and h % typo == 0:
                        if size == min_chars:
                            continue
                        at = h % size
                        run_ = run_[:at] + run_[at + 1 :]
                    held[run_] += n
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return run


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 5, min_count: int = 3, typo: int = 97) -> DataFrame:
    """``word, n``: the words of at least ``min_chars`` code points that occur ``min_count`` times or more.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased.  If ``typo``
    divides crc32 of ``id:word``, the word loses the code point at that crc32 modulo its length,
    which makes misspelt words to look for; 0 leaves all as they are.
    """
    small_batches(docs.sparkSession)
    cells = docs.select(column(id_col).cast("string").alias("id"), column(text_col).alias("text"))
    return cells.mapInArrow(_words(min_chars, typo), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _answer(group: pa.Table) -> pa.Table:
    """For each word asked in a task: how many near words there are, and the most frequent one."""
    cols = {"word": [], "n": [], "n_near": [], "form_n": [], "form": []}
    for back in (False, True):
        rows = group.filter(pc.equal(group.column("back"), back))
        if not len(rows):
            continue
        words, counts = rows.column("word").to_pylist(), rows.column("n").to_pylist()
        known = {(w[::-1] if back else w): n for w, n, gives in zip(words, counts, rows.column("gives").to_pylist(), strict=True) if gives}
        order = sorted(known)
        found = Automaton(order)
        held = [known[w] for w in order]
        if back:
            order = [w[::-1] for w in order]
        for word, n, asks in zip(words, counts, rows.column("asks").to_pylist(), strict=True):
            if not asks:
                continue
            half = len(word) // 2
            near = found.near(word[::-1], len(word) - half) if back else found.near(word, half)
            if back and near:
                head = word[:half]
                near = [x for x in near if not order[x].startswith(head)]  # these the forward search has
            best = min(((-held[x], order[x]) for x in near), default=(0, None))
            for name, value in zip(cols, (word, n, len(near), -best[0] if near else None, best[1]), strict=True):
                cols[name].append(value)
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.table({name: pa.array(values, kind) for (name, values), kind in zip(cols.items(), kinds, strict=True)})


def near_words(words: DataFrame, *, min_chars: int = 5, bucket_words: int = BUCKET_WORDS, part_words: int = PART_WORDS) -> DataFrame:
    """``word, n, n_near, form_n, form``: for each of ``words`` (``word, n``, no word twice, ``min_chars`` code points or more) its near words' number, and the one of largest ``n``.

    Ties go to the smaller word in code-point order; without a near word there is 0 and null.
    """
    total = words.count()
    size = F.length("word")
    lengths = lambda up: F.array_distinct(F.array(*[F.floor((size + d + up) / 2).cast("int") for d in (-1, 0, 1)]))  # noqa: E731 - halves of words one shorter, as long and one longer
    own = F.floor(size / 2).cast("int")
    ahead = F.transform(lengths(0), lambda n: F.struct(F.lit(False).alias("back"), F.substring("word", F.lit(1), n).alias("half"), (n == own).alias("asks")))
    behind = F.transform(lengths(1), lambda n: F.struct(F.lit(True).alias("back"), F.substring("word", size - n + 1, n).alias("half"), (n == size - own).alias("asks")))
    rows = words.select("word", "n", F.explode(F.concat(ahead, behind)).alias("k")).select("word", "n", "k.*")
    buckets = max(1, -(-4 * total // bucket_words))
    parts = F.lit(1)
    if total > part_words:  # else no half has so many words
        hot = rows.groupBy("back", "half").agg(F.count("*").alias("k")).filter(F.col("k") > part_words).select("back", "half", F.ceil(F.col("k") / part_words).alias("parts"))
        rows, parts = rows.join(hot, ["back", "half"], "left"), F.coalesce("parts", F.lit(1))  # 4 * total / part_words rows at most; Spark sees their size
    held = F.pmod(F.xxhash64("word"), parts)
    dealt = rows.withColumn("held", held).withColumn("part", F.explode(F.when(F.col("asks"), F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)).otherwise(F.array(held))))
    alone = F.when(parts > 1, F.concat(F.col("back").cast("string"), "half"))  # halves that are dealt over parts share no task with others, where their words would be met again
    dealt = dealt.select(F.pmod(F.xxhash64("half"), F.lit(buckets)).alias("bucket"), alone.alias("alone"), "part", "back", "word", "n", "asks", (F.col("part") == F.col("held")).alias("gives"))
    found = dealt.groupBy("bucket", "alone", "part").applyInArrow(_answer, "word string, n long, n_near long, form_n long, form string")
    best = F.min(F.when(F.col("form").isNotNull(), F.struct(-F.col("form_n"), "form")))
    out = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    return out.select("word", "n", "n_near", (-F.col("b.col1")).alias("form_n"), F.col("b.form").alias("form"))


def roots(links: DataFrame, *, max_rounds: int = 64) -> DataFrame:
    """``word, root`` for ``links`` (``word, form``; a word once, no circles): where the links from each word end.

    Every round doubles the steps taken and is written to the shared folder.
    """
    now = materialize(links.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(max_rounds):
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = materialize(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if now.filter("moved").isEmpty():
            return now.drop("moved")
        now = now.drop("moved")
    raise RuntimeError(f"links did not end in {max_rounds} rounds")


def spelling_variants(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 5, min_count: int = 3, ratio: int = 2, typo: int = 0,
    bucket_words: int = BUCKET_WORDS, part_words: int = PART_WORDS,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: every word of the texts with the form that it is likely a variant of.

    A word's form is its near word (one code point inserted, deleted or replaced) of largest ``n``,
    ties to the smaller in code-point order, if that has ``ratio`` times the word's ``n`` or more.
    ``root`` follows forms to the last; it is the word itself without any.  See
    :func:`word_counts` for what a word is.

    Defined cases: null and empty texts have no words; repeated rows count each; a null id counts
    as empty text; words of any length are whole; an empty table gives an empty table.  Other columns are not read.
    """
    if min_chars < 2 or ratio < 2:
        raise ValueError("min_chars and ratio must be 2 or more")
    words = materialize(word_counts(docs, id_col=id_col, text_col=text_col, min_chars=min_chars, min_count=min_count, typo=typo), "spelling-words")
    found = materialize(near_words(words, min_chars=min_chars, bucket_words=bucket_words, part_words=part_words), "spelling-near")
    fits = F.col("form_n") >= ratio * F.col("n")
    found = found.select("word", F.when(fits, F.col("form")).alias("form"), "n", "n_near", F.when(fits, F.col("form_n")).alias("form_n"))
    ends = roots(found.filter("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"), typo=97)


OP11_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS c FROM range(256) AS r(b))),
runs AS (
  SELECT doc_id, w, count(*) AS k FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents)
  WHERE length(w) >= 5 GROUP BY ALL),
hashed AS (
  SELECT w, k, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(strlen(s)), lambda i: CAST('0x' || substr(hex(encode(s)), 2 * i + 1, 2) AS BIGINT))),
    lambda c, x: xor(c // 256, t[1 + xor(c, x) % 256]))) AS h
  FROM (SELECT w, k, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS s FROM runs), bits),
words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
    SELECT k, CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cut AS (SELECT word, n, p, substr(word, 1, p) || substr(word, p + 2) AS c FROM (SELECT word, n, unnest(range(length(word))) AS p FROM words)),
near AS (
  SELECT DISTINCT a.word AS a, a.n AS n, b.word AS b, b.n AS m FROM cut a JOIN cut b ON a.c = b.c AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.c = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.c = b.word),
ranked AS (SELECT a, n, b, m, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY m DESC, encode(b)) AS r FROM near),
formed AS (
  SELECT w.word, w.n, CAST(coalesce(r.n_near, 0) AS BIGINT) AS n_near, CASE WHEN r.m >= 2 * w.n THEN r.b END AS form, CASE WHEN r.m >= 2 * w.n THEN r.m END AS form_n
  FROM words w LEFT JOIN ranked r ON r.a = w.word AND r.r = 1),
walk AS (
  SELECT word, word AS at, form AS next FROM formed
  UNION ALL SELECT w.word, w.next, f.form FROM walk w JOIN formed f ON f.word = w.next)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN walk w ON w.word = f.word AND w.next IS NULL
"""
