"""Spelling variants by anagram hashing.

A word's key is the sum of a power of each of its letters, whatever their order. Words that differ by
one letter have keys that differ by one letter's value: taking a letter from the longer word gives
the shorter one's key, and an exchange is met where both words give up their odd letter. Key and
half of the word, one of which such words share, are joined; the order of the letters is
verified then.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quern.llm._spark import checkpointed, forget, map_partitions

#: Code points of a word at least, and its occurrences.
LETTERS, OCCURRENCES = 5, 3
#: One run in so many is altered, by the checksum of its document's id and itself.
ALTERED = 97
#: A word's form occurs at least so many times as often.
FACTOR = 2
#: The power of a letter's place in the alphabet that keys add up.
POWER = 5
#: Words and their bytes that a task adds up before it passes them on.
COUNTED, COUNTED_BYTES = 200_000, 32 << 20
#: Rounds of doubling after which following forms is given up as faulty; a form is at least twice as frequent as its word, so 6 do.
MAX_ROUNDS = 8

#: A run in UTF-8: A-Z, a-z (lower-cased by then) and U+00C0 to U+00FF.
_RUN = re.compile(rb"(?:[a-z]++|\xc3[\x80-\xbf])+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def altered(run: bytes, checksum: int) -> bytes:
    """A run, without the code point that its checksum picks if ``ALTERED`` divides that."""
    if checksum % ALTERED:
        return run
    text = run.decode()
    at = checksum % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of at least ``LETTERS`` code points, counted per task before they are shuffled."""

    def run(batches):
        total: Counter[bytes] = Counter()
        held = 0

        def counted():
            words = [w.decode() for w in total]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                runs = Counter(_RUN.findall((text.as_py() or "").encode().translate(_LOWER)))
                start = None if doc_id is None else zlib.crc32(b"%d:" % doc_id)
                for word, n in runs.items():
                    if start is not None:
                        word = altered(word, zlib.crc32(word, start))
                    if len(word) >= LETTERS and (word.isascii() or len(word.decode()) >= LETTERS):
                        if word not in total:
                            held += len(word)
                        total[word] += n
                if len(total) > COUNTED or held > COUNTED_BYTES:
                    yield counted()
                    total.clear()
                    held = 0
        yield counted()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_partitions(docs, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _value(letter: Column) -> Column:
    """A letter's place in the alphabet (a-z, then U+00C0 on) to the power, which keeps sums of billions of letters within a long."""
    code = F.ascii(letter).cast("long")
    place = F.when(code < 128, code - 96).otherwise(code - 0xC0 + 27)
    return F.pow(place, F.lit(POWER)).cast("long")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of distinct words that differ by one code point, each once.

    ``words`` has (word, n), each word once. Rows to join are keyed by a key less one letter, the length
    of what is left and its first or second half: an inserted, deleted or exchanged letter
    stands in one half only, so near words share the other. Cells then hold
    words that differ in one half alone, and no cell is large because a letter or a length is frequent.
    """
    letters = F.filter(F.split("word", ""), lambda c: c != "")
    size = F.char_length("word")
    known = words.select("word", "n", letters.alias("letters"), size.alias("size"))
    known = known.select("word", "n", "size", F.array_distinct("letters").alias("odd"), F.aggregate("letters", F.lit(0).cast("long"), lambda s, c: s + _value(c)).alias("key"))
    less = known.select("word", "n", "size", "key", F.explode(F.transform("odd", _value)).alias("value")).select("word", "n", "size", (F.col("key") - F.col("value")).alias("key"))

    def sides(rows: DataFrame, length: Column, head: Column, tail: Column) -> DataFrame:
        halves = F.explode(F.array(F.struct(F.lit(0).alias("side"), head.alias("half")), F.struct(F.lit(1).alias("side"), tail.alias("half"))))
        return rows.select("word", "n", "key", length.alias("length"), halves.alias("h")).select("word", "n", "key", "length", "h.side", "h.half")

    def first(at: Column) -> Column:
        return F.substring("word", F.lit(1), at)

    def after(at: Column) -> Column:
        return F.substring("word", at + 1, size)

    cells = ["key", "length", "side", "half"]
    middle = F.floor(F.col("size") / 2).cast("int")
    # exchanges: both words are of one length and give up their odd letter; exactly one of their halves is equal
    one = sides(less, F.col("size"), first(middle), after(middle))
    other = one.select(*cells, F.col("word").alias("near"), F.col("n").alias("near_n"))
    exchanged = one.join(other, cells).where("word < near")
    # one letter more: the halves are those of the shorter word, with the odd letter skipped
    short = sides(known, F.col("size"), first(middle), after(middle))
    inner = F.floor((F.col("size") - 1) / 2).cast("int")
    long = sides(less, F.col("size") - 1, first(inner), after(inner + 1)).select(*cells, F.col("word").alias("near"), F.col("n").alias("near_n"))
    cut = F.floor(F.col("length") / 2).cast("int")
    both = F.substring("word", F.lit(1), cut) == F.substring("near", F.lit(1), cut)
    # a pair that shares both halves is kept for the first
    added = short.join(long, cells).where((F.col("side") == 0) | ~both)
    pairs = exchanged.unionByName(added).where(F.levenshtein("word", "near", 1) == 1)
    way = F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return pairs.select(F.explode(F.array(*way)).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, form, root) of (word, form): forms followed to the last; a word without a form is its own root.

    Pointer doubling: every round a word's pointer becomes that of the word it points to, so chains of 2^k forms
    take k rounds. Each round is written to the checkpoint folder and the one before deleted; words
    whose pointer has arrived at a root are looked up by the others and not joined again.
    """
    state = checkpointed(forms.select("word", "form", F.coalesce("form", "word").alias("up"), F.col("form").isNull().alias("arrived")))
    for _ in range(MAX_ROUNDS):
        going = state.where("not arrived")
        if going.isEmpty():
            return state.select("word", "form", F.col("up").alias("root"))
        ahead = state.select(F.col("word").alias("up"), F.col("up").alias("further"), F.col("arrived").alias("there"))
        moved = going.join(ahead, "up").select("word", "form", F.col("further").alias("up"), F.col("there").alias("arrived"))
        last, state = state, checkpointed(state.where("arrived").unionByName(moved))
        forget(last)
    raise RuntimeError("forms do not end")


def variants(docs: DataFrame, occurrences: int = OCCURRENCES, factor: int = FACTOR) -> DataFrame:
    """word, form, root (string), n, n_near, form_n (long) of every frequent word of ``docs`` (doc_id, text).

    Words are counted over all rows. Texts that are null or empty have none; rows of one id each count; the runs
    of a row without an id are not altered. Of near words of one n the smallest in code-point order is the
    form. No words give no rows.
    """
    words = checkpointed(word_counts(docs).where(F.col("n") >= occurrences))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.less") >= factor * F.col("n"), F.col("best")).alias("best"))
    found = checkpointed(found.select("word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n")))
    return found.drop("form").join(roots(found), "word").select("word", "form", "root", "n", "n_near", "form_n")


def sql() -> str:
    """DuckDB SQL for ``variants`` over ``documents``: CRC-32 step by step, words cut at every place, forms followed one by one."""
    table = "list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    return f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT {table} AS t),
runs AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents) GROUP BY ALL),
keyed AS (SELECT doc_id, w, n, hex(encode(doc_id || ':' || w)) AS x FROM runs),
summed AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT))),
  lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM keyed, crc),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % {ALTERED} = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, n FROM summed)
  WHERE length(word) >= {LETTERS} GROUP BY word HAVING sum(n) >= {OCCURRENCES}),
cuts AS MATERIALIZED (SELECT word, i, word[:i - 1] AS head, word[i + 1:] AS tail FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word AS a, b.word AS b FROM cuts a JOIN cuts b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cuts c JOIN words w ON w.word = c.head || c.tail UNION SELECT w.word, c.word FROM cuts c JOIN words w ON w.word = c.head || c.tail),
best AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-n, b)) AS near, max(n) AS near_n FROM pairs JOIN words ON b = word GROUP BY a),
found AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {FACTOR} * n THEN near END AS form, CASE WHEN near_n >= {FACTOR} * n THEN near_n END AS form_n FROM words LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS at FROM found UNION ALL SELECT walk.word, f.form FROM walk JOIN found f ON f.word = walk.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n FROM found f JOIN walk USING (word) JOIN found g ON g.word = walk.at WHERE g.form IS NULL"""
