"""Benchmark decontamination by template windows.

Texts become templates: numbers, units after numbers, and names (capitalised words
that are no common opening of a sentence) are replaced by typed placeholders.  Windows of ``WIDTH``
template words, and of plain words, of all documents are hash-joined with those of the benchmark.  An
item is found in a text if at least ``SHARE`` percent of its windows are; the values in
its placeholders then must map one to one onto the text's, so that a question asked
again with other numbers or names is caught and a chance likeness is not.

Of the documents' windows only those that pass a filter of fixed size over the benchmark's hashes are
written; the join looks up each item's rarest windows, which no text that holds the item can miss.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import NULL_ID, Scratch, real_id, slim, tidy, tidy_group
from .textvec import U, Words, arrow_texts, blocks, mix, seeds
from .toxicity import _BREAK

#: Template words of a window, literal words it has at least, and the percentage of an item's windows that a text must hold.
WIDTH, LITERAL, SHARE = 5, 3, 80
#: Bits of a cell's number in the filter, and parts that a window's texts are dealt to.
FILTER, SALTS = 23, 8
#: Units, those of one measure together: spelled otherwise a unit is still the same value.
_UNITS = [
    x.split() for x in (
        "km kilometer kilometers kilometre kilometres|m meter meters metre metres|cm centimeter centimeters centimetre centimetres|mm millimeter millimeters|mi mile miles|ft foot feet|in inch inches|yd yard yards|"
        "kg kilogram kilograms kilo kilos|g gram grams|mg milligram milligrams|lb lbs pound pounds|oz ounce ounces|ton tons tonne tonnes|l liter liters litre litres|ml milliliter milliliters|gallon gallons|cup cups|"
        "s sec second seconds|ms|min mins minute minutes|h hr hrs hour hours|day days|week weeks|month months|year years|decade decades|century centuries|"
        "kmh kph|mph|usd dollar dollars|eur euro euros|gbp|cent cents|yen|percent pct|degree degrees|celsius|fahrenheit|k|w watt watts|kw|kwh|v volt volts|a amp amps|ohm ohms|hz|khz|mhz|ghz|"
        "j joule joules|kj|n newton newtons|pa|kpa|cal kcal calorie calories|mol|byte bytes|bit bits|kb|mb|gb|tb|acre acres|ha hectare hectares"
    ).split("|")
]
#: Words that open sentences and are no names.
_OPENERS = (
    "a an the this that these those there here it its he she they we you i his her their our my your and but or nor so yet if then else when while where what which who whom whose why how "
    "in on at of for to from by with without within into onto over under between among through during before after since until till about above below near as like than because although though unless whether "
    "each every all any both some many much more most few fewer less several no none not one two three four five six seven eight nine ten half first second third last next another other others such same "
    "is are was were be been do does did has have had can could will would shall should may might must let suppose assume given consider find compute calculate determine solve evaluate simplify estimate "
    "write show prove explain describe express convert choose select give name state list use using also now once only just however therefore thus hence meanwhile later earlier finally today yesterday tomorrow "
    "question answer problem example note please yes"
).split()
_UPPER = np.array([chr(c).isupper() for c in range(1 << 16)])
_NUM, _UNIT, _NAME = (U(x) for x in (0x1111111111111111, 0x2222222222222222, 0x3333333333333333))


def _flags(buf: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many bytes of ``buf`` (true or false) each span holds."""
    upto = np.concatenate(([0], np.cumsum(buf)))
    return upto[end] - upto[at]


class Template:
    """Template words of a block of texts: hash, kind (0 literal, 1 number, 2 unit, 3 name) and plain hash of each.

    A number holds its separators (1,250 or 2.5), an attached unit is a word of its own,
    names that follow each other are one.  ``value`` is the plain hash, one for all spellings of a unit; ``parts`` counts words.
    """

    def __init__(self, texts: list[bytes]):
        w = Words(texts, space=_BREAK)
        raw = w.raw
        digit = (raw >= 48) & (raw < 58)
        _detach(w, digit)
        start, end, plain, n = w.start, w.end, w.hashes(), len(w.start)
        number = _flags(digit, start, end) == end - start
        upper = (raw >= 65) & (raw < 91)
        opens, unit, name = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
        if n:
            stop = np.isin(raw, np.frombuffer(b".!?:\n", np.uint8))
            opens[1:] = _flags(stop, end[:-1], start[1:]) > 0
            opens[w.first[:-1][w.first[:-1] < n]] = True
            unit[1:] = np.isin(plain[1:], _unit_hashes()[0]) & number[:-1] & ~opens[1:]
            n_upper = _flags(upper, start, end)
            shouted = (n_upper == end - start) & (end - start > 1)
            beside = np.zeros(n, bool)
            beside[1:] |= shouted[:-1]
            beside[:-1] |= shouted[1:]
            # Words in capitals among others like them are shouted text, not names.
            name = _capital(raw, start) & (_letters(raw, start, end) > 1) & ~(shouted & beside)
            name &= ~(opens & np.isin(plain, _opener_hashes())) & ~unit
        kind = np.select([number, unit, name], [1, 2, 3], 0).astype(np.int8)
        if n:
            same = np.zeros(n, bool)
            close = start[1:] - end[:-1] == 1
            gap = raw[end[:-1]]
            same[1:] = close & (kind[1:] == kind[:-1]) & ((kind[1:] == 1) & np.isin(gap, np.frombuffer(b".,:/", np.uint8)) | (kind[1:] == 3) & (gap == 32))
            same[w.first[:-1][w.first[:-1] < n]] = False
            head = np.flatnonzero(~same)
            self.parts = np.diff(np.append(head, n))
            w.start, w.end = start[head], end[head + self.parts - 1]
            w.first = np.searchsorted(head, w.first)
            kind = kind[head]
        else:
            self.parts = np.zeros(0, np.int64)
        self.first, self.kind, self.plain = w.first, kind, w.hashes()
        self.hash = np.select([kind == 1, kind == 2, kind == 3], [_NUM, _UNIT, _NAME], self.plain).astype(U)
        self.value = self.plain.copy()
        units, measures = _unit_hashes()
        at = np.flatnonzero(kind == 2)
        self.value[at] = measures[np.searchsorted(units, self.plain[at])]

    def windows(self, width: int, plain: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of windows, of templates with enough literal words or of plain words, the word each begins at, and its text."""
        n = len(self.hash) - width + 1
        none = np.zeros(0, np.int64)
        if n <= 0:
            return np.zeros(0, U), none, none
        factor = seeds(width, 43 if plain else 41) | U(1)
        words = self.plain if plain else self.hash
        h = np.zeros(n, U)
        for k in range(width):
            h += words[k : k + n] * factor[k]
        h = mix(h + U(width))
        text = np.searchsorted(self.first, np.arange(n), "right") - 1
        upto = np.concatenate(([0], np.cumsum(self.kind == 0)))
        good = (np.arange(n) + width <= self.first[text + 1]) & (plain | (upto[width:] - upto[:n] >= min(LITERAL, width)))
        at = np.flatnonzero(good)
        return h[at], at, text[at]


def _capital(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the UTF-8 character that begins at each place is an upper-case letter."""
    a, b, c = (raw[np.minimum(at + k, len(raw) - 1)].astype(np.int64) for k in range(3))
    code = np.where(a < 0x80, a, np.where(a < 0xE0, (a & 0x1F) << 6 | b & 0x3F, (a & 0xF) << 12 | (b & 0x3F) << 6 | c & 0x3F))
    return _UPPER[code] & (a < 0xF0)


def _letters(raw: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    return _flags((raw & 0xC0) != 0x80, at, end)


def _detach(w: Words, digit: np.ndarray) -> None:
    """Cut a number from the unit attached to it."""
    other = np.append(np.flatnonzero(~digit), len(digit))
    at = other[np.searchsorted(other, w.start)] if len(w.start) else w.start
    some = np.flatnonzero((at > w.start) & (at < w.end))
    if not len(some):
        return
    start, end, first = w.start, w.end, w.first
    w.start, w.end = at[some], end[some]
    some = some[np.isin(w.hashes(), _unit_hashes()[0])]
    w.start, w.end = np.insert(start, some + 1, at[some]), np.insert(end, some, at[some])
    w.first = first + np.searchsorted(some, first)


_units: tuple[np.ndarray, np.ndarray] | None = None
_openers: np.ndarray | None = None


def _unit_hashes() -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all units, sorted, and the hash of each one's measure."""
    global _units
    if _units is None:
        each, of = (Words([x.encode() for x in xs], space=_BREAK).hashes() for xs in ([x for u in _UNITS for x in u], [u[0] for u in _UNITS for _ in u]))
        order = np.argsort(each)
        _units = each[order], of[order]
    return _units


def _opener_hashes() -> np.ndarray:
    global _openers
    if _openers is None:
        _openers = Words([x.encode() for x in _OPENERS], space=_BREAK).hashes()
    return _openers


def _item_windows(t: Template) -> Iterator[tuple[bool, int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(plain, width, hash, first word, text)`` of the windows that texts are looked for by: ``WIDTH`` words, or a shorter text whole."""
    sizes = np.diff(t.first)
    for width in range(1, WIDTH + 1):
        if width == WIDTH or (sizes == width).any():
            for plain in (False, True):
                h, at, text = t.windows(width, plain)
                keep = sizes[text] >= WIDTH if width == WIDTH else sizes[text] == width
                yield plain, width, h[keep], at[keep], text[keep]


def _needed(total):
    """Windows of an item that a text must hold."""
    return -(-SHARE * total // 100)


def _benchmark_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(item, plain, width, total, h)``: each item's distinct windows, and how many there are."""
    for batch in batches:
        keys = batch.column("item").to_numpy()
        for numbers, texts in blocks(list(range(batch.num_rows)), arrow_texts(batch)):
            for plain, width, h, _, text in _item_windows(Template(texts)):
                both = np.unique(np.stack((text.astype(U), h)), axis=1) if len(h) else np.zeros((2, 0), U)
                text, h = both[0].astype(np.int64), both[1]
                total = np.bincount(text, minlength=len(texts))[text]
                n = len(h)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[np.array(numbers)[text]]), pa.array(np.full(n, plain)), pa.array(np.full(n, width, np.int32)), pa.array(total), pa.array(h.view(np.int64))],
                    names=["item", "plain", "width", "total", "h"],
                )


def _place(h: np.ndarray) -> np.ndarray:
    return (h.view(U) >> U(64 - FILTER)).astype(np.int64)


def _filter(windows: DataFrame) -> np.ndarray:
    """One bit for each of 2**FILTER cells, set where a window's hash falls: a size that no benchmark changes.  Built in pieces, by all tasks."""
    piece = 1 << (FILTER - 6)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER, bool)
        for batch in batches:
            bits[_place(batch.column("h").to_numpy())] = True
        some = [k for k in range(64) if bits[k * piece : (k + 1) * piece].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([np.packbits(bits[k * piece : (k + 1) * piece]).tobytes() for k in some], pa.binary())], names=["piece", "bits"])

    def unite(table: pa.Table) -> pa.Table:
        all_ = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()])
        return pa.table({"piece": table.column("piece")[:1], "bits": pa.array([all_.tobytes()], pa.binary())})

    out = np.zeros(1 << FILTER, bool)
    for row in windows.select("h").mapInArrow(tidy(mark), "piece int, bits binary").groupBy("piece").applyInArrow(tidy_group(unite), "piece int, bits binary").collect():
        out[row["piece"] * piece : (row["piece"] + 1) * piece] = np.unpackbits(np.frombuffer(row["bits"], np.uint8)).astype(bool)
    return out


def _text_windows(held, widths: list[int]):
    """``(id, th, h)``: each text's distinct windows that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(held.value, np.uint8)).astype(bool)
        for batch in batches:
            ids, ties = batch.column("id").to_numpy(), batch.column("th").to_numpy()
            for numbers, texts in blocks(list(range(batch.num_rows)), arrow_texts(batch)):
                t, got = Template(texts), [np.zeros((2, 0), U)]
                for width in widths:
                    for plain in (False, True):
                        h, _, text = t.windows(width, plain)
                        some = np.flatnonzero(bits[_place(h)])
                        got.append(np.stack((text[some].astype(U), h[some])))
                text, h = np.unique(np.concatenate(got, axis=1), axis=1)
                row = np.array(numbers, np.int64)[text.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(ties[row]), pa.array(h.view(np.int64))], names=["id", "th", "h"])

    return run


def _matches(t: Template, of_text: dict[bool, tuple], text: int, own: Template, of_item: list[tuple], item: int) -> tuple | None:
    """``(windows, found, slots, changed slots, kind)`` of an item that the text holds: by templates, or failing these by plain words as a copy."""
    best = None
    for plain in (False, True):
        mine = [(h[x == item], (at - own.first[item])[x == item]) for p, _, h, at, x in of_item if p == plain]
        h, place = (np.concatenate([m[k] for m in mine]) for k in (0, 1))
        total = len(np.unique(h))
        if not total:
            continue
        theirs, at, first = of_text[plain]
        theirs, at = theirs[first[text] : first[text + 1]], at[first[text] : first[text + 1]]
        a, b = np.searchsorted(theirs, h), np.searchsorted(theirs, h, "right")
        found = len(np.unique(h[b > a]))
        if found < _needed(total):
            continue
        n = b - a
        which = np.repeat(np.arange(len(h)), n)
        begin = at[a[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)] - place[which]
        kind, slots, changed = _slots(t, text, own, item, total, np.stack((h[which].view(np.int64), begin)))
        if kind == "verbatim" or kind and not plain:
            now = (total, found, slots, changed, kind)
            best = now if best is None or best[-1] != "verbatim" else best
    return best


def _slots(t: Template, text: int, own: Template, item: int, total: int, met: np.ndarray) -> tuple[str | None, int, int]:
    """Holds the item's placeholders against the text's, at the place where most of its windows lie and at
    every other that has enough of them.  ``met``: each window's hash and where the item would begin."""
    places = Counter(np.unique(met, axis=1)[1].tolist())
    best = None
    for begin, held in sorted(places.items(), key=lambda x: (-x[1], x[0])):
        if best is not None and held < _needed(total):
            break
        now = _held(t, text, own, item, begin)
        if best is None or best[0] is None and now[0] or now[0] == "verbatim":
            best = now
        if best[0] == "verbatim":
            break
    return best


def _held(t: Template, text: int, own: Template, item: int, begin: int) -> tuple[str | None, int, int]:
    a, b = own.first[item], own.first[item + 1]
    slots = np.flatnonzero(own.kind[a:b])
    where = slots + begin
    inside = (where >= t.first[text]) & (where < t.first[text + 1])
    slots, where = slots[inside], where[inside]
    # A name at the item's edge can have grown together with one of the text around it.
    grown = ((slots == 0) | (slots == b - a - 1)) & (own.kind[a + slots] == 3) & (t.parts[where] > own.parts[a + slots])
    fits = (t.kind[where] == own.kind[a + slots]) & ~grown
    changed = int((own.plain[a + slots[fits]] != t.plain[where[fits]]).sum())
    mine, theirs = own.value[a + slots[fits]].tolist(), t.value[where[fits]].tolist()
    one_way, other_way = dict(zip(mine, theirs, strict=True)), dict(zip(theirs, mine, strict=True))
    steady = all(one_way[x] == y and other_way[y] == x for x, y in zip(mine, theirs, strict=True))
    return ("verbatim" if not changed else "reparameterised" if steady else None), len(slots), changed


_OUT = "id long, th long, item_id long, n_windows long, n_found long, share double, n_slots int, n_changed int, kind string"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decides candidates: rows (id, th, text, items [(item_id, body)])."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    fields = [c.split() for c in _OUT.split(", ")]
    for batch in batches:
        ids, ties, items = (batch.column(c).to_pylist() for c in ("id", "th", "items"))
        rows = []
        for numbers, texts in blocks(list(range(batch.num_rows)), arrow_texts(batch)):
            t = Template(texts)
            asked = {(x["item_id"], x["body"]): None for k in numbers for x in items[k]}
            own = Template([body.encode() for _, body in asked])
            index = {x: k for k, x in enumerate(asked)}
            of_item = list(_item_windows(own))
            of_text = {}
            for plain in (False, True):
                got = [t.windows(w, plain) for w in sorted({w for _, w, *_ in of_item})]
                h, at, text = (np.concatenate([g[k] for g in got]) for k in range(3))
                order = np.lexsort((at, h, text))
                of_text[plain] = h[order], at[order], np.searchsorted(text[order], np.arange(len(texts) + 1))
            for k, number in enumerate(numbers):
                for x in items[number]:
                    got = _matches(t, of_text, k, own, of_item, index[x["item_id"], x["body"]])
                    if got:
                        total, found, slots, changed, kind = got
                        rows.append((ids[number], ties[number], x["item_id"], total, found, found / total, slots, changed, kind))
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
        yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[f for f, _ in fields])


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``_OUT``, ``th`` a hash of the text that tells rows of one id apart."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    texts = slim(docs).withColumn("th", F.xxhash64("text"))
    items = benchmark.select(F.coalesce(benchmark["item_id"].cast("long"), F.lit(NULL_ID)).alias("item_id"), F.coalesce(benchmark["text"].cast("string"), F.lit("")).alias("text")).distinct()
    items = scratch.keep(items.withColumn("item", F.monotonically_increasing_id()), "items")
    windows = scratch.keep(items.select("item", "text").mapInArrow(tidy(_benchmark_windows), "item long, plain boolean, width int, total long, h long"), "windows")
    widths = [r[0] for r in windows.select("width").distinct().collect()]  # at most WIDTH numbers
    if not widths:
        return spark.createDataFrame([], _OUT)
    held = spark.sparkContext.broadcast(np.packbits(_filter(windows)).tobytes())  # 2**FILTER bits
    met = scratch.keep(texts.mapInArrow(tidy(_text_windows(held, sorted(widths))), "id long, th long, h long"), "met")

    # A text that holds enough of an item's windows holds one of any that are more than it may miss: the rarest ones are looked up.
    often = met.groupBy("h").agg(F.count("*").alias("n"))
    rarest = F.row_number().over(Window.partitionBy("item", "plain").orderBy(F.coalesce("n", F.lit(0)), "h"))
    probes = windows.join(often, "h", "left").withColumn("nth", rarest).where(F.col("nth") <= F.col("total") - F.expr(f"({SHARE} * total + 99) div 100") + 1)
    probes = probes.where("n is not null").select("item", "h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    pairs = met.withColumn("salt", F.pmod(F.xxhash64("id", "th"), F.lit(SALTS)).cast("int")).join(probes, ["h", "salt"]).select("id", "th", "item").distinct()
    asked = pairs.join(items.select("item", "item_id", F.col("text").alias("body")), "item")
    asked = asked.groupBy("id", "th", F.pmod(F.xxhash64("item"), F.lit(64)).alias("lot")).agg(F.collect_list(F.struct("item_id", "body")).alias("items"))
    return scratch.keep(texts.join(asked, ["id", "th"]).select("id", "th", "text", "items").mapInArrow(tidy(_verify), _OUT).distinct(), "found")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_windows, n_found, share, n_slots, n_changed, kind``: a row for each item found in a text.

    ``kind`` is ``verbatim`` (no placeholder differs) or ``reparameterised`` (they
    differ, each value always in the same way).  An item of fewer words than a window is one
    window; an item whose windows have too few literal words is found as a verbatim copy only.  Items
    without words and null or empty texts are in no row.  Rows of one id and text are one row here, rows of one id and
    several texts are judged each; equal items of several ids are found each.  Texts of any length are searched
    whole; other columns are ignored, whatever their names; empty tables have no rows.
    """
    found = _found(docs, benchmark).drop("th").distinct()
    return found.select(real_id().alias("doc_id"), real_id("item_id").alias("item_id"), *[c.split()[0] for c in _OUT.split(", ")[3:]])


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, whose text holds no benchmark item."""
    gone = _found(docs, benchmark).select("id", "th").distinct()
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    rows = docs.select(whole.alias("row"), F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("th"))
    return rows.join(gone, ["id", "th"], "left_anti").select("row.*")
