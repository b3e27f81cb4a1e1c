"""Spelling variants: two-dimensional range reporting over prefix and suffix order.

Two words are near if one edit turns one into the other.  For an edit position the near words of a
word share the prefix before it and the suffix after it: an interval of the words in forward order,
and one of the words in reverse order.  A wavelet tree over the reverse ranks in forward order reports
the words in both intervals; as all of them have one length, each is exactly one edit away.

A shard is a length, a range of edit positions, and the letters outside it, which all of its words
share.  At first the positions of a length are two ranges, so words meet that share one half.  A shard
of over SHARD letters is halved by its positions, which fixes more letters, down to single positions,
where no more words are left than there are letters.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut

#: Letters of the words that one shard, and one step of a task, hold.
SHARD = 1 << 21
#: Entries of a task's table of counts before they are handed on.
COUNTED = 1 << 18
#: Letters of a text that are searched at a time.
PIECE = 1 << 20
LETTER = "A-Za-zÀ-ÿ"
CAPITALS = {k: k + 32 for k in range(65, 91)}


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces of about PIECE characters that end beside no letter."""
    lo, end = 0, re.compile(f"[^{LETTER}]")
    while len(text) - lo > PIECE:
        found = end.search(text, lo + PIECE)
        hi = found.end() if found else len(text)
        yield text[lo:hi]
        lo = hi
    yield text[lo:]


def word_counts(docs: DataFrame, least: int, every: int) -> DataFrame:
    """word, n: the words of at least `least` letters and how often they occur, after one letter is deleted where `every` divides the hash of id and word."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, total = re.compile(f"[{LETTER}]{{{least},}}"), Counter()

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                lower: Counter = Counter()
                for piece in _pieces(text):
                    for word, n in Counter(runs.findall(piece)).items():
                        lower[word if word.islower() else word.lower() if word.isascii() else word.translate(CAPITALS)] += n
                start = zlib.crc32(f"{doc}:".encode())
                for word, n in lower.items():
                    h = zlib.crc32(word.encode(), start)
                    if not h % every:
                        if len(word) == least:
                            continue
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    total[word] += n
                if len(total) > COUNTED:
                    yield handed()
                    total.clear()
        if total:
            yield handed()

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").alias("text")).where("text IS NOT NULL")
    return rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _keyed(rows: DataFrame) -> DataFrame:
    """rows with the key of their shard: a hash of the letters outside its positions."""
    short = F.when(F.col("member"), 0).otherwise(1)  # a shorter word lacks the letter at the edit
    outside = [F.substring("word", F.lit(1), F.col("lo")), F.substring(F.col("word"), F.col("hi") - short + 1, F.char_length("word"))]
    return rows.withColumn("key", F.xxhash64("size", "lo", "hi", *outside))


def _halved(rows: DataFrame) -> DataFrame:
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    parts = F.explode(F.array(F.struct("lo", middle.alias("hi")), F.struct(middle.alias("lo"), "hi"))).alias("part")
    return rows.select("size", "member", "word", "n", parts).select("size", "part.lo", "part.hi", "member", "word", "n")


def shards(words: DataFrame, most: int) -> DataFrame:
    """size, lo, hi, key, member, word, n: each word in the shards of its length, and of one letter more as a query."""
    long = F.char_length("word")
    sizes = F.explode(F.array(F.struct(long.alias("size"), F.lit(True).alias("member")), F.struct((long + 1).alias("size"), F.lit(False).alias("member")))).alias("as")
    rows = words.select("word", "n", sizes).select("as.size", F.lit(0).alias("lo"), F.col("as.size").alias("hi"), "as.member", "word", "n")
    shard, done = ["size", "lo", "hi", "key"], None
    rows = _keyed(_halved(rows))
    while True:
        full = rows.groupBy(*shard).agg(F.count("*").alias("c")).where((F.col("c") * F.col("size") > most) & (F.col("hi") - F.col("lo") > 1))
        full = cut(full.select(*shard), "full-shards")
        if full.isEmpty():
            return done.unionByName(rows) if done else rows
        some = rows.join(full, shard, "left_anti")
        done = done.unionByName(some) if done else some
        rows = _keyed(_halved(rows.join(full, shard, "left_semi")))


class WaveletTree:
    """The values 0 to n-1 in some order, bit by bit from the highest; reports those in a range of places and a range of values."""

    def __init__(self, values: np.ndarray):
        self.levels: list[tuple[int, int, np.ndarray]] = []
        for k in range(max(0, int(len(values) - 1).bit_length()) - 1, -1, -1):
            ones = (values >> k & 1).astype(bool)
            zeros = np.concatenate([[0], np.cumsum(~ones)])
            self.levels.append((k, int(zeros[-1]), zeros))
            values = np.concatenate([values[~ones], values[ones]])

    def report(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) for the values in [least, end) at places [lo, hi) of each query."""
        query, base = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        some = (lo < hi) & (least < end)
        query, base, lo, hi = query[some], base[some], lo[some], hi[some]
        for k, first, zeros in self.levels:
            l0, h0 = zeros[lo], zeros[hi]
            query, base = np.concatenate([query, query]), np.concatenate([base, base + (1 << k)])
            lo, hi = np.concatenate([l0, lo - l0 + first]), np.concatenate([h0, hi - h0 + first])
            some = (lo < hi) & (base < end[query]) & (base + (1 << k) > least[query])
            query, base, lo, hi = query[some], base[some], lo[some], hi[some]
        return query, base


def _ranked(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows of letters, and how many letters neighbours in it share."""
    order = np.argsort(np.ascontiguousarray(letters).view(f"S{letters.shape[1]}").ravel(), kind="stable")
    unlike = letters[order[1:]] != letters[order[:-1]]
    shared = np.where(unlike.any(1), unlike.argmax(1), letters.shape[1])
    return order, shared


def _interval(shared: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of an order, the places [lo, hi) whose words share `least` letters with it."""
    starts = np.concatenate([[True], shared < least])
    at = np.flatnonzero(starts)
    run = np.cumsum(starts) - 1
    return at[run], np.append(at[1:], len(starts))[run]


def near_words(size: int, positions: range, words: list[bytes], member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) for each pair of a word a and a member b with one edit between them at one of the positions; an edit that fits at several counts at the first.

    Members have `size` letters and are queries too; the other words have one less.
    """
    n = len(words)
    letters = np.zeros((n, size), np.uint8)
    flat = np.frombuffer(b"".join(words), np.uint8)
    letters[np.arange(size) < np.where(member, size, size - 1)[:, None]] = flat
    turned = letters[:, ::-1].copy()
    turned[~member] = np.roll(turned[~member], -1, axis=1)  # the filling stays behind the letters
    forward, ahead = _ranked(letters)
    reverse, behind = _ranked(turned)
    place_f, place_r = np.empty(n, np.int64), np.empty(n, np.int64)
    place_f[forward], place_r[reverse] = np.arange(n), np.arange(n)
    # members only have ranks of their own in both orders
    rank_f, rank_r = (np.concatenate([[0], np.cumsum(member[order])]) for order in (forward, reverse))
    inner_f, inner_r = forward[member[forward]], reverse[member[reverse]]
    tree = WaveletTree(rank_r[place_r[inner_f]])
    found_a, found_b = [], []
    most_f, most_r = (int(x.max(initial=0)) for x in (ahead, behind))
    for i in range(max(positions.start, size - 1 - most_r), min(positions.stop, most_f + 1)):
        lo, hi = (rank_f[x] for x in _interval(ahead, i))
        least, end = (rank_r[x] for x in _interval(behind, size - 1 - i))
        lo, hi, least, end = lo[place_f], hi[place_f], least[place_r], end[place_r]
        some = np.flatnonzero(np.minimum(hi - lo, end - least) > member)
        if not len(some):
            continue
        a, value = tree.report(lo[some], hi[some], least[some], end[some])
        a, b = some[a], inner_r[value]
        first = np.ones(len(a), bool) if i == 0 else member[a] | (letters[b, i - 1] != letters[b, i])
        keep = (a != b) & first
        found_a.append(a[keep])
        found_b.append(b[keep])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_a]), np.concatenate([none, *found_b])


def _summed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """word, n_near, best_n, best: for the words of one shard or several of one size and range, what they add to their near words."""
    t = pa.Table.from_batches(held)
    text = t.column("word").to_pylist()
    words, n, member = [w.encode("latin-1") for w in text], t.column("n").to_numpy(), t.column("member").to_numpy()
    size, lo, hi = (t.column(c)[0].as_py() for c in ("size", "lo", "hi"))
    a, b = near_words(size, range(lo, hi), words, member)
    other = ~member[a]  # a longer word is near the shorter one that found it
    a, b = np.concatenate([a, b[other]]), np.concatenate([b, a[other]])
    order = np.argsort(np.array(words, dtype=f"S{size}"), kind="stable")
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    by = np.lexsort([place[b], -n[b], a])
    a, b = a[by], b[by]
    at = np.flatnonzero(np.diff(a, prepend=-1))
    near = np.diff(np.append(at, len(a)))
    names = pa.array(text)
    return pa.RecordBatch.from_arrays([names.take(pa.array(a[at])), pa.array(near, pa.int64()), pa.array(n[b[at]], pa.int64()), names.take(pa.array(b[at]))], ["word", "n_near", "best_n", "best"])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of shards, taken together up to SHARD letters where their size and positions are the same."""
    held: list[pa.RecordBatch] = []
    letters, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        size, lo, hi, key = (batch.column(c).to_numpy() for c in ("size", "lo", "hi", "key"))
        kind = np.stack([size, lo, hi, key])
        starts = np.flatnonzero(np.append(True, (kind[:, 1:] != kind[:, :-1]).any(0))).tolist()
        begin = 0
        for at in starts:
            now = tuple(kind[:, at].tolist())
            begun = letters + int(size[begin:at].sum())
            if last is not None and now != last and (now[:3] != last[:3] or begun > SHARD):
                if at > begin:
                    held.append(batch.slice(begin, at - begin))
                if held:
                    yield _summed(held)
                held, letters, begin = [], 0, at
            last = now
        held.append(batch.slice(begin))
        letters += int(size[begin:].sum())
    if held:
        yield _summed(held)


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: from each word that has a form, the last of the chain of forms; each round doubles the way."""
    ways = cut(forms.select("word", F.col("form").alias("root")), "ways")
    while True:
        ahead = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ways = cut(ways.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "ways")
        if ways.where("moved").isEmpty():
            return ways.select("word", "root")
        ways = ways.select("word", "root")


def spelling_variants(docs: DataFrame, least: int = 7, every: int = 31, occurrences: int = 2, ratio: int = 10, shard: int = SHARD) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are maximal runs of Latin letters, A-Z in lower case, of at least `least` letters and that many
    occurrences; where `every` divides the crc32 of id and word, one letter is deleted.  Near words are
    one inserted, deleted or replaced letter apart.  A word's form is its near word with the most
    occurrences (ties: the first in code-point order), if these are `ratio` times its own; its root is
    the last of the forms that follow.  Null texts have no words and a null id is an empty one; repeated
    rows count each; words of any length are compared whole; an empty table gives no rows; other columns
    are not read.
    """
    bounded_batches(docs.sparkSession)
    words = cut(word_counts(docs, least, every).where(F.col("n") >= occurrences), "words")
    kind = ["size", "lo", "hi", "key"]
    rows = shards(words, shard).select(*kind, "member", "word", "n").repartition(*kind).sortWithinPartitions(*kind)
    found = rows.mapInArrow(_searched, "word string, n_near long, best_n long, best string")
    best = found.groupBy(F.col("word").alias("of")).agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("first"))
    large = -F.col("first.less") >= ratio * F.col("n")
    listed = words.join(best, F.col("word") == F.col("of"), "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(large, F.col("first.best")).alias("form"), F.when(large, -F.col("first.less")).alias("form_n"))
    listed = cut(listed, "listed")
    roots = _roots(listed.where("form IS NOT NULL"))
    return listed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = r"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents WHERE text IS NOT NULL),
low AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM runs WHERE len(run) > 6 GROUP BY ALL),
hex AS (SELECT *, hex(encode(doc_id || ':' || w)) AS x FROM low),
bytes AS (SELECT w, n, list_transform(range(1, len(x)::BIGINT, 2), lambda k: (16 * (instr('0123456789ABCDEF', x[k]) - 1) + instr('0123456789ABCDEF', x[k + 1]) - 1)::BIGINT) AS b FROM hex),
h AS (SELECT w, n, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1]))) AS h FROM bytes, tab),
v AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN w[1:(h % len(w))::BIGINT] || w[(h % len(w) + 2)::BIGINT:] ELSE w END AS word, n FROM h) WHERE len(word) > 6 GROUP BY word HAVING sum(n) > 1),
spots AS (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM v),
cutout AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM spots),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM cutout AS a JOIN cutout AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, v.word, v.n FROM cutout AS c JOIN v ON v.word = c.rest UNION SELECT v.word, c.word, c.n FROM cutout AS c JOIN v ON v.word = c.rest),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
first AS (SELECT near.word, min(other) AS other FROM near JOIN best USING (word, m) GROUP BY near.word),
f AS (SELECT v.word, CASE WHEN m >= 10 * n THEN other END AS form, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 10 * n THEN m END AS form_n FROM v LEFT JOIN best USING (word) LEFT JOIN first USING (word)),
walk AS (SELECT word, word AS here FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.here WHERE f.form IS NOT NULL),
roots AS (SELECT walk.word, here AS root FROM walk JOIN f ON f.word = here WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN roots USING (word)
"""
