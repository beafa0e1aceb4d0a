"""Spelling variants: words one edit apart, the frequent word that each stands for, and the root of that chain.

Counting is one pass over the texts: tasks add up their words and hand on sums. Near words are found by halves. Whatever one edit does to a word,
one of its halves stays whole: the first at the begin of the other word, or the second at its end. Halves are dealt to shards by a hash of
(half, length of the word, its letters), each shard puts its halves in one Aho-Corasick automaton, and every word is scanned in the shards that
could hold a half of it, at most six, instead of in all. A match counts if it stands at the begin or end and the lengths differ by one at
most; then the other halves are compared. Halves of more than LISTED words keep an index of these words' rests with one letter left out,
so that a frequent half costs its letters and not its words. Halves of more than HOT words would fill a shard: these are compared
by a join on (half, rest with one letter left out), whose groups hold as many rows as there are letters for a place.

Defined results: null and empty texts have no words; a null doc_id is the empty text before the colon; repeated rows count again; a text without
words counts for nothing; no words at all give no rows; other columns play no part. Texts count whole, in pieces cut between words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import staged, texts_of, width
from sieveline.operators.staging import small_or_shuffled

LEAST_LETTERS, LEAST_COUNT, TIMES, DROP = 6, 5, 5, 199
#: Halves in a shard, about; words of a half that are compared one by one; words of a half beyond which it is joined instead.
SHARD, LISTED, HOT = 1 << 17, 16, 1 << 15
_RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LETTERS},}}")
_BETWEEN = re.compile("[^a-zÀ-ÿ]")
_PIECE, _HELD, _OUT = 1 << 20, 1 << 18, 1 << 14


def _words_of(text: str) -> Counter:
    low = text.encode().lower().decode()  # bytes are lowered in A-Z alone
    found: Counter = Counter()
    at = 0
    while at < len(low):
        cut = _BETWEEN.search(low, at + _PIECE) if at + _PIECE < len(low) else None
        end = cut.start() if cut else len(low)
        found.update(_RUN.findall(low, at, end))
        at = end
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, int] = defaultdict(int)

    def out() -> Iterator[pa.RecordBatch]:
        words, counts = pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())
        for i in range(0, len(words), _OUT):
            yield pa.RecordBatch.from_arrays([words[i : i + _OUT], counts[i : i + _OUT]], names=["word", "n"])
        held.clear()

    for batch in batches:
        for i, key in enumerate(batch.column("key").to_pylist()):
            begin = zlib.crc32(f"{key}:".encode())
            for run, n in _words_of(batch.column("text")[i].as_py() or "").items():
                h = zlib.crc32(run.encode(), begin)
                if not h % DROP:
                    k = h % len(run)
                    run = run[:k] + run[k + 1 :]
                    if len(run) < LEAST_LETTERS:
                        continue
                held[run] += n
            if len(held) > _HELD:
                yield from out()
    yield from out()


def vocabulary(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of the texts that occur often enough, after the deletions."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), "text")
    sums = own.where("text is not null").mapInArrow(_counted, "word string, n long")
    return sums.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def one_edit(a: str, b: str) -> bool:
    """Whether a and b differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def _without_one(rest: str) -> list[str]:
    return [rest[:i] + rest[i + 1 :] for i in range(len(rest))]


class _Half:
    """The words of one half, of one length: a list while they are few, an index by rests with a letter left out beyond."""

    def __init__(self, first: bool, letters: int, half: int):
        self.first, self.letters, self.half, self.words, self.index = first, letters, half, [], None

    def rest(self, word: str) -> str:
        return word[self.half :] if self.first else word[: len(word) - self.half]

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """(near word, its number) for words that hold the half in its place; a second half leaves to the first one what that finds."""
        if len(self.words) <= LISTED:
            found = (w for w in self.words if one_edit(word, w[0]))
        else:
            found = self._looked_up(word)
        begin = self.letters // 2
        return (w for w in found if self.first or word[:begin] != w[0][:begin])

    def _looked_up(self, word: str) -> Iterator[tuple[str, int]]:
        if self.index is None:
            self.index = defaultdict(list)
            for w in self.words:
                rest = self.rest(w[0])
                self.index[rest].append(w)
                gone = _without_one(rest)
                for i, g in enumerate(gone):
                    self.index[i, g].append(w)
                for g in set(gone):
                    self.index[-1, g].append(w)
        rest = self.rest(word)
        if len(word) == self.letters:
            keys = enumerate(_without_one(rest))
        else:
            keys = [(-1, rest)] if len(word) < self.letters else set(_without_one(rest))
        return (w for k in keys for w in self.index.get(k, ()) if w[0] != word)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a shard: its halves first, then the words to scan; (word, n_near, best, best_n) for words with near ones."""
    import ahocorasick

    shard, halves, automaton = None, {}, None
    for batch in batches:
        out = []
        for of, query, word, n, first, letters in zip(*(batch.column(c).to_pylist() for c in ("shard", "query", "word", "n", "first", "letters"))):
            if of != shard:
                shard, halves, automaton = of, {}, None
            if not query:
                cut = letters // 2
                half = word[:cut] if first else word[cut:]
                own = halves.setdefault(half, {})
                if (first, letters) not in own:
                    own[first, letters] = _Half(first, letters, len(half))
                own[first, letters].words.append((word, n))
                continue
            if not halves:
                continue
            if automaton is None:
                automaton = ahocorasick.Automaton()
                for half, own in halves.items():
                    automaton.add_word(half, (len(half), list(own.values())))
                automaton.make_automaton()
            n_near, best = 0, (0, "")
            for end, (size, own) in automaton.iter(word):
                begins, ends = end + 1 == size, end + 1 == len(word)
                if not (begins or ends):
                    continue
                for half in own:
                    if (begins if half.first else ends) and abs(len(word) - half.letters) <= 1:
                        for other, m in half.near(word):
                            n_near += 1
                            if m > best[0] or m == best[0] and other < best[1]:
                                best = (m, other)
            if n_near:
                out.append((word, n_near, best[1], best[0]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["word", "n_near", "best", "best_n"])


def _half_key(word: Column, letters: Column, first: bool) -> Column:
    """(first, letters, half) as it would be for a word of so many letters that holds `word`'s begin or end."""
    cut = F.floor(letters / 2).cast("int")
    half = F.substr(word, F.lit(1), cut) if first else F.substr(word, F.length(word) - (letters - cut) + 1, letters - cut)
    return F.struct(F.lit(first).alias("first"), letters.cast("int").alias("letters"), half.alias("half"))


def _near_by_join(owners: DataFrame, scanned: DataFrame) -> DataFrame:
    """What `_scan` finds, for halves of very many words: owners (first, letters, half, word, n) against scanned ones (first, letters, half, word)."""
    key = ["first", "letters", "half"]
    size = F.length("half")
    rest = F.when(F.col("first"), F.substr(F.col("word"), size + 1, F.length("word") - size)).otherwise(F.substr(F.col("word"), F.lit(1), F.length("word") - size))
    gone = F.transform(F.sequence(F.lit(1), F.length("rest")), lambda i: F.concat(F.substr(F.col("rest"), F.lit(1), i - 1), F.substr(F.col("rest"), i + 1, F.length("rest"))))
    own, seen = owners.withColumn("rest", rest), scanned.withColumn("rest", rest)
    at = [*key, "place", "cut"]
    pos = lambda df: df.select("*", F.posexplode(gone).alias("place", "cut"))
    once = lambda df: df.select("*", F.explode(F.array_distinct(gone)).alias("cut"))
    whole = lambda df: df.withColumn("cut", F.col("rest"))
    sides = [
        (pos(own), pos(seen.where(F.length("word") == F.col("letters"))), at),
        (once(own), whole(seen.where(F.length("word") < F.col("letters"))), [*key, "cut"]),
        (whole(own), once(seen.where(F.length("word") > F.col("letters"))), [*key, "cut"]),
    ]
    found = None
    for a, b, on in sides:
        pairs = b.select(*on, "word").join(a.select(*on, F.col("word").alias("best"), F.col("n").alias("best_n")), on).where("word <> best").select(*key, "word", "best", "best_n")
        found = pairs if found is None else found.unionByName(pairs)
    begin = F.floor(F.col("letters") / 2).cast("int")
    return found.where(F.col("first") | (F.substr(F.col("word"), F.lit(1), begin) != F.substr(F.col("best"), F.lit(1), begin))).select("word", F.lit(1).cast("long").alias("n_near"), "best", "best_n")


def near_words(vocab: DataFrame, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """(word, n_near, best, best_n) for words with near ones: their number, and the most frequent one, ties by code points.

    vocab: (word, n), each word once, staged.
    """
    spark = vocab.sparkSession
    letters = F.length("word")
    mine = [_half_key(F.col("word"), letters, f) for f in (True, False)]
    theirs = [_half_key(F.col("word"), letters + d, f) for f in (True, False) for d in (-1, 0, 1)]
    owners = vocab.select("word", "n", F.explode(F.array(*mine)).alias("key")).select("word", "n", "key.*")
    shards = max(width(spark), -(-2 * vocab.count() // shard))
    route = lambda k: F.pmod(F.xxhash64(k["first"], k["letters"], k["half"]), F.lit(shards)).cast("int")
    crowded = staged(owners.groupBy("first", "letters", "half").count().where(F.col("count") > hot).drop("count"), "crowded")
    by_join = None
    if not crowded.isEmpty():
        on = ["first", "letters", "half"]
        few = small_or_shuffled(crowded)
        scanned = vocab.select("word", F.explode(F.array(*theirs)).alias("key")).select("word", "key.*").join(few, on)
        by_join = _near_by_join(owners.join(few, on), scanned)
        owners = owners.join(few, on, "left_anti")
    rows = owners.select(route({c: F.col(c) for c in ("first", "letters", "half")}).alias("shard"), F.lit(False).alias("query"), "word", "n", "first", "letters")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("n", "long"), ("first", "boolean"), ("letters", "int"))]
    rows = rows.unionByName(vocab.select(F.explode(F.array_distinct(F.array(*map(route, theirs)))).alias("shard"), F.lit(True).alias("query"), "word", *none))
    found = rows.repartition(shards, "shard").sortWithinPartitions("shard", "query").mapInArrow(_scan, "word string, n_near long, best string, best_n long")
    found = found.unionByName(by_join) if by_join is not None else found
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best"))
    return best.select("word", "n_near", F.col("best.word").alias("best"), (-F.col("best.n")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each row of forms (word, form): the last form of the chain. Each round doubles the steps, and a chain of counts that grow TIMES-fold is short."""
    own = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = own.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = staged(own.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        own = step.drop("moved")
        if step.where("moved").isEmpty():
            return own


def group_variants(docs: DataFrame, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of the texts."""
    vocab = staged(vocabulary(docs), "vocabulary")
    near = near_words(vocab, shard, hot)
    fits = F.col("best_n") >= TIMES * F.col("n")
    rows = vocab.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n"))
    rows = staged(rows, "forms")
    chain = roots(rows.where("form is not null"))
    return rows.join(chain, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same in SQL: checksums byte by byte from their table, near words by what is left without one letter.
SQL = f"""WITH RECURSIVE bits AS (SELECT 0 AS i, CAST(range AS BIGINT) AS c, CAST(range AS BIGINT) AS k FROM range(256)
  UNION ALL SELECT i + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END, k FROM bits WHERE i < 8),
 tab AS (SELECT list(c ORDER BY k) AS tab FROM bits WHERE i = 8),
 occ AS (SELECT key, run, count(*) AS c FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS key, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= {LEAST_LETTERS} GROUP BY key, run),
 raw AS (SELECT key, run, c, encode(key || ':' || run) AS b FROM occ),
 sums AS (SELECT run, c, xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(regexp_replace(hex(b), '(..)', '\\1 ', 'g'), ' ')[1:octet_length(b)], lambda x: CAST('0x' || x AS BIGINT))),
   lambda a, v: xor(a >> 8, tab[CAST((xor(a, v) & 255) + 1 AS BIGINT)]))) AS h FROM raw, tab),
 left_ AS (SELECT CASE WHEN h % {DROP} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM sums),
 v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM left_ WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}),
 d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
 near AS (SELECT a.word, b.word AS other, b.n AS m FROM d a JOIN d b ON a.i = b.i AND a.cut = b.cut WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM d a JOIN v b ON a.cut = b.word UNION SELECT b.word, a.word, a.n FROM d a JOIN v b ON a.cut = b.word),
 best AS (SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS p FROM near),
 f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {TIMES} * v.n THEN other END AS form, CASE WHEN m >= {TIMES} * v.n THEN m END AS form_n FROM v LEFT JOIN best ON best.word = v.word AND p = 1),
 up AS (SELECT word, word AS root, 0 AS k FROM f UNION ALL SELECT up.word, f.form, k + 1 FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL)
SELECT f.word, form, max_by(root, k) AS root, n, n_near, form_n FROM f JOIN up USING (word) GROUP BY f.word, form, n, n_near, form_n"""
