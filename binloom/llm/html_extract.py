"""Main text of pages by union-free regular expressions inferred for each host.

The children of an element are a stream of keys (tag and names of an element, # for text).  Streams of
one place on the pages of one host are aligned again and again: keys that only some have become
optional, keys that come again or in another order become a repeated group, text becomes a slot.  What
comes out for all places of a host is its wrapper.  A slot of a wrapper is the host's own wording if
its text never changes and it isn't in a repeated group; otherwise it is data.  The article is the
data within the container that markup names or, where it names none, within the deepest one that holds
most of the host's data.

Streams and slots are summed up within tasks and then by (host, place), so a host with most of the pages
is some rows of each task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bounded_batches, cut, runs
from .html_pages import TEXT, parsed, path_of

#: A cell: repeated, optional, and its keys, each with whether it is optional there.
Cell = tuple[bool, bool, tuple[tuple[str, bool], ...]]
#: Places in a task's table before it is handed on.
PLACES = 1 << 15
#: What a named container, and a container of data, must hold of a host's letters.
NAMED_SHARE, DATA_SHARE = 0.25, 0.6
#: Pages on which a slot's text must be the same to be the host's wording; letters in links beyond which a slot is a menu.
SAME, LINKED = 3, 0.5


def reduced(keys: tuple[str, ...]) -> list[Cell]:
    """A stream of keys as cells: from the first to the last of a key that comes again is a repeated group."""
    last = {k: i for i, k in enumerate(keys)}
    cells, at = [], 0
    while at < len(keys):
        end, i = last[keys[at]], at
        while i < end:
            i += 1
            end = max(end, last[keys[i]])
        part = keys[at : end + 1]
        rounds: list[list[str]] = []
        for k in part:
            if k == part[0]:
                rounds.append([])
            rounds[-1].append(k)
        inner = list(dict.fromkeys(part))
        cells.append((len(part) > 1, False, tuple((k, any(k not in r for r in rounds)) for k in inner)))
        at = end + 1
    return cells


def aligned(a: list[Cell], b: list[Cell]) -> list[Cell]:
    """The cells that match what either matches: unlike orders become a repeated group, what one lacks becomes optional."""
    place = {k: j for j, c in enumerate(b) for k, _ in c[2]}
    # stretches of a with the stretch of b that they share keys with
    stretches: list[list[int]] = []  # from and to in a, from and to in b, or -1
    most = -1
    for i, cell in enumerate(a):
        at = [place[k] for k, _ in cell[2] if k in place]
        now = [i, i, min(at, default=-1), max(at, default=-1)]
        while at and stretches and most >= now[2]:
            before = stretches.pop()
            met = [x for x in (before, now) if x[2] >= 0]
            now = [before[0], now[1], min(x[2] for x in met), max(x[3] for x in met)]
            most = max((x[3] for x in stretches), default=-1)
        stretches.append(now)
        most = max(most, now[3])
    out, at = [], 0
    for a0, a1, b0, b1 in stretches:
        if b0 >= 0:
            out += [(r, True, keys) for r, _, keys in b[at:b0]]
            at = b1 + 1
        left, right = a[a0 : a1 + 1], b[b0 : b1 + 1] if b0 >= 0 else []
        out.append(_joined(left, right))
    return out + [(r, True, keys) for r, _, keys in b[at:]]


def _joined(left: list[Cell], right: list[Cell]) -> Cell:
    """One cell of cells that share keys."""
    sides = [{k: o or (c[1] and len(side) > 1) for c in side for k, o in c[2]} for side in (left, right) if side]
    several = max(len(left), len(right)) > 1
    keys = list(dict.fromkeys(k for s in sides for k in s))
    optional = lambda k: any(s.get(k, True) for s in sides)
    repeated = several or any(c[0] for c in left + right)
    skipped = not right or (not several and any(c[1] for c in left + right))
    return repeated, skipped, tuple((k, len(keys) > 1 and optional(k)) for k in keys)


def as_text(cells: list[Cell], inner: dict[str, str]) -> str:
    """A regular expression of cells; inner has what an element's key stands for."""
    out = []
    for repeated, optional, keys in cells:
        said = " ".join(f"{inner.get(k, k)}{'?' * o}" for k, o in keys)
        out.append(f"({said}){'*' if repeated and optional else '+' if repeated else '?'}" if repeated or optional else said)
    return " ".join(out)


def host_of(url: Column) -> Column:
    """The host in lower case without user and port; an empty text where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch: kind 0, the cells of each place; kind 1, each slot; kind 2, what the highest named level of a page holds."""
    known: dict = {}
    names = ["kind", "host", "place", "cells", "level", "holders", "ancestors", "pages", "chars", "linked", "least", "most"]
    cells: dict[tuple[int, int], list[Cell]] = {}
    seen: set = set()
    slots: dict[tuple[int, int, int], list] = {}
    tops: dict[tuple[int, int], list] = {}

    def handed() -> pa.RecordBatch:
        rows = [(0, host, place, json.dumps(c), None, None, None, 0, 0, 0, None, None) for (host, place), c in cells.items()]
        rows += [(1, host, slot, None, level, *x) for (host, slot, level), x in slots.items()]
        rows += [(2, host, 0, None, level, None, None, 0, chars, whole, None, None) for (host, level), (chars, whole) in tops.items()]
        for x in (cells, seen, slots, tops):
            x.clear()
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, OBSERVED)], names)

    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            structure: dict[int, set] = {}
            blocks = parsed(page, known, structure)
            for place, streams in structure.items():
                for stream in streams:
                    if (host, place, stream) not in seen:
                        seen.add((host, place, stream))
                        new, old = reduced(stream), cells.get((host, place))
                        cells[host, place] = new if old is None or old == new else aligned(old, new)
            met = set()
            for b in blocks:
                h = hash_of(b.text)
                x = slots.setdefault((host, b.slot, b.level), [list(b.holders), list(b.ancestors), 0, 0, 0, h, h])
                x[2] += (b.slot, b.level) not in met
                x[3] += len(b.text)
                x[4] += b.linked
                x[5], x[6] = min(x[5], h), max(x[6], h)
                met.add((b.slot, b.level))
            if blocks:
                top = max(b.level for b in blocks)
                x = tops.setdefault((host, top), [0, 0])
                x[0] += sum(len(b.text) for b in blocks if b.level == top)
                x[1] += sum(len(b.text) for b in blocks)
            if len(seen) + len(slots) > PLACES:
                yield handed()
    if cells:
        yield handed()


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


OBSERVED = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells of each place of a host from all that tasks have aligned."""
    out = []
    for group in runs(batches, ["host", "place"]):
        cells = None
        for text in group.column("cells").to_pylist():
            new = [(r, o, tuple(map(tuple, keys))) for r, o, keys in json.loads(text)]
            cells = new if cells is None else aligned(cells, new)
        out.append((group.column("host")[0].as_py(), group.column("place")[0].as_py(), json.dumps(cells)))
        if len(out) >= 1000:
            yield _packed(out)
            out = []
    if out:
        yield _packed(out)


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    host, place, cells = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(host, pa.int64()), pa.array(place, pa.int64()), pa.array(cells, pa.string())], ["host", "place", "cells"])


def observed(pages: DataFrame) -> DataFrame:
    """What tasks see of pages (host: long, html): see _observed."""
    schema = "kind int, host long, place long, cells string, level int, holders array<long>, ancestors array<long>, pages long, chars long, linked long, least long, most long"
    return pages.mapInArrow(_observed, schema)


def wrappers(seen: DataFrame) -> DataFrame:
    """host, place, cells: one regular expression for the children of each place, from the rows of observed()."""
    each = seen.where("kind = 0").select("host", "place", "cells").distinct()
    return each.repartition("host", "place").sortWithinPartitions("host", "place", "cells").mapInArrow(_folded, "host long, place long, cells string")


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, place) of the children that are in a repeated group."""
    known: dict = {}
    for batch in batches:
        out = [(h, path_of(p, k, known)) for h, p, cells in zip(*(batch.column(c).to_pylist() for c in ("host", "place", "cells"))) for repeated, _, keys in json.loads(cells) if repeated for k, _ in keys]
        host, place = np.array(out, np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([pa.array(host), pa.array(place)], ["host", "place"])


def article_rules(seen: DataFrame) -> DataFrame:
    """One row per host: host, levels (bits of named containers that hold articles), container (a place), wording (slots in it that are no data)."""
    slots = seen.where("kind = 1").groupBy("host", "place", "level").agg(F.first("holders").alias("holders"), F.first("ancestors").alias("ancestors"), *(F.sum(c).alias(c) for c in ("pages", "chars", "linked")), F.min("least").alias("least"), F.max("most").alias("most"))
    slots = cut(slots, "slots")
    repeated = cut(wrappers(seen).mapInArrow(_repeats, "host long, place long").distinct(), "repeated")
    # a slot and what it lies in; one of these in a repeated group is enough
    inside = slots.select("host", F.col("place").alias("slot"), F.explode(F.array_append("ancestors", F.col("place"))).alias("place")).distinct()
    inside = inside.join(repeated, ["host", "place"], "left_semi").select("host", F.col("slot").alias("place")).distinct()
    slots = slots.join(inside.withColumn("again", F.lit(True)), ["host", "place"], "left")
    same = (F.col("least") == F.col("most")) & (F.col("pages") >= SAME) & F.col("again").isNull()
    slots = slots.withColumn("data", ~same & (F.col("linked") <= LINKED * F.col("chars")))
    varied = F.max("data").over(W.partitionBy("host"))
    # a host whose pages are all copies of each other has no slot that changes
    slots = cut(slots.withColumn("data", F.when(varied, F.col("data")).otherwise(F.col("linked") <= LINKED * F.col("chars"))), "slots")
    tops = seen.where("kind = 2 AND level > 0").groupBy("host", "level").agg(F.sum("chars").alias("chars"), F.sum("linked").alias("whole"))
    levels = tops.where(F.col("chars") >= NAMED_SHARE * F.col("whole")).groupBy("host").agg(F.sum(F.expr("shiftleft(1, level)")).cast("int").alias("levels"))
    free = slots.where("data").join(levels, "host", "left").where("levels IS NULL OR shiftright(levels, level) % 2 = 0").select("host", "chars", F.posexplode("holders").alias("depth", "place"))
    held = free.groupBy("host", "place", "depth").agg(F.sum("chars").alias("chars"))
    most = F.max("chars").over(W.partitionBy("host"))
    container = held.withColumn("whole", most).where(F.col("chars") >= DATA_SHARE * F.col("whole")).groupBy("host").agg(F.max(F.struct("depth", "chars", "place")).alias("of")).select("host", F.col("of.place").alias("container"))
    container = cut(container, "containers")
    wording = slots.where("NOT data").join(container, "host").where(F.array_contains("holders", F.col("container"))).groupBy("host").agg(F.collect_set("place").alias("wording"))
    hosts = seen.select("host").distinct()
    return hosts.join(levels, "host", "left").join(container, "host", "left").join(wording, "host", "left")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slots of each page and its blocks, each with the number of its slot on the page."""
    known: dict = {}
    kinds = pa.list_(pa.struct([("slot", pa.int64()), ("level", pa.int32()), ("holders", pa.list_(pa.int64()))])), pa.list_(pa.struct([("k", pa.int32()), ("text", pa.string())]))
    for batch in batches:
        slots, blocks = [], []
        for page in batch.column("html").to_pylist():
            at: dict = {}
            mine = [(at.setdefault(b[:3], len(at)), b.text) for b in parsed(page, known)]
            slots.append([{"slot": s, "level": level, "holders": list(holders)} for s, level, holders in at])
            blocks.append([{"k": k, "text": text} for k, text in mine])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "host")), pa.array(slots, kinds[0]), pa.array(blocks, kinds[1])], ["page_id", "url", "host", "slots", "blocks"])


def _hosted(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.xxhash64(host_of(F.col("url"))).alias("host"), F.coalesce("html", F.lit("")).alias("html"))


def host_wrappers(pages: DataFrame) -> DataFrame:
    """host (hash), place, wrapper: each place of a host as a union-free regular expression over its children's keys."""
    bounded_batches(pages.sparkSession)

    def said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [as_text([(r, o, tuple(map(tuple, keys))) for r, o, keys in json.loads(c)], {}) for c in batch.column("cells").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("place"), pa.array(text, pa.string())], ["host", "place", "wrapper"])

    return wrappers(observed(_hosted(pages).select("host", "html"))).mapInArrow(said, "host long, place long, wrapper string")


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    The text is the article's blocks in page order, joined by one space, character references decoded,
    white space turned into one space.  Null and empty pages, and pages without article text, have an
    empty text; a null url is a host of its own.  Repeated rows are pages of their own.  Pages of any
    length are read whole; elements nested deeper than DEPTH belong to their ancestor.  An empty table
    gives no rows; other columns are not read.
    """
    bounded_batches(pages.sparkSession)
    rows = _hosted(pages)
    seen = cut(observed(rows.select("host", "html")), "observed")
    rules = cut(article_rules(seen), "article-rules")
    schema = "page_id long, url string, host long, slots array<struct<slot:long,level:int,holders:array<long>>>, blocks array<struct<k:int,text:string>>"
    found = rows.mapInArrow(_blocks, schema).join(rules, "host", "left")
    levels = F.coalesce("levels", F.lit(0))
    found = found.withColumn("level", F.array_max(F.transform("slots", lambda s: F.when(F.call_function("shiftright", levels, s["level"]) % 2 == 1, s["level"]).otherwise(0))))
    data = lambda s: F.array_contains(s["holders"], F.col("container")) & ~F.coalesce(F.array_contains("wording", s["slot"]), F.lit(False))
    kept = F.transform("slots", lambda s: F.when(F.col("level") > 0, s["level"] == F.col("level")).otherwise(F.coalesce(data(s), F.lit(False))))
    found = found.withColumn("kept", kept)
    text = F.array_join(F.transform(F.filter("blocks", lambda b: F.get("kept", b["k"])), lambda b: b["text"]), " ")
    return found.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


SQL = r"""
WITH p AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS x FROM pages),
t AS (SELECT page_id, url, regexp_replace(x, '<[^>]*>', ' ', 'g') AS x FROM p),
u AS (SELECT page_id, url, regexp_replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;?', '&', 'g') AS x FROM t)
SELECT page_id, url, trim(regexp_replace(x, '\s+', ' ', 'g')) AS text, len(trim(regexp_replace(x, '\s+', ' ', 'g')))::BIGINT AS n_chars FROM u
"""
