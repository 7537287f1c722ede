"""Quality rules: text counts, then perplexity under a modified Kneser-Ney model of byte n-grams, one per language."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthstat.llm import ngrams, packets
from hearthstat.llm.ngrams import add_up, group_sums, look_up
from hearthstat.llm.shared import save
from hearthstat.llm.words import Words, lower_ascii, mix, per_text

ORDER = 5
LANGUAGES = 1 << 16
LOWER, UPPER = 4.0, 4.0
SETTLE = 8000
SKETCH = 4
LEAST_SPREAD = 0.05
_PAIRS = list(combinations(range(SKETCH), 2))
_PLACE = "key long, rank long, chunk long, place int, facts binary"
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_MASK = lambda j: np.uint64((1 << 8 * j) - 1)


class Facts:
    """The base counts of a chunk's documents, whether each fails the base rules, and its least sketch; computed once a chunk and handed on in packed form."""

    _FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "sketch")

    def __init__(self, numbers: np.ndarray):
        for name, own in zip(self._FIELDS, numbers):
            setattr(self, name, own)
        self.failed = (self.n_words < 10) | (100 * self.n_repeat_words > 20 * self.n_words)

    def pack(self) -> bytes:
        return packets.squeeze(np.concatenate([getattr(self, name) for name in self._FIELDS]))

    @classmethod
    def unpack(cls, body: bytes) -> Facts:
        return cls(packets.expand(body, np.int64).reshape(len(cls._FIELDS), -1))


def base_counts(chunk: packets.Chunk, words: Words) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a chunk's documents."""
    spans = np.zeros(len(chunk.data) + 1, np.int8)
    spans[words.starts] += 1
    spans[words.ends] -= 1
    in_word = np.cumsum(spans[:-1], dtype=np.int8).view(bool)
    word_chars = per_text(in_word & ((chunk.data & 0xC0) != 0x80), chunk.offsets)
    n_symbols = per_text(_SYMBOLS[chunk.data], chunk.offsets)
    n_dup_lines = np.zeros(len(chunk), np.int64)
    for i in range(len(chunk)):
        lines = [line for line in chunk.text(i).split(b"\n") if line.strip()]
        n_dup_lines[i] = len(lines) - len(set(lines))
    hashes, valid = words.windows(5)
    at = np.flatnonzero(valid)
    with np.errstate(over="ignore"):
        keys = hashes[at] + words.docs[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    # a key that stands once is told by its neighbours in sorted order; places are looked up only for the few that repeat
    ordered = np.sort(keys)
    same = ordered[1:] == ordered[:-1]
    twice = at[np.isin(keys, np.unique(ordered[1:][same]))] if same.any() else at[:0]
    n = len(words.starts) + 1
    edges = np.bincount(twice, minlength=n) - np.bincount(twice + 5, minlength=n)
    n_repeat_words = np.bincount(words.docs[np.cumsum(edges[:-1]) > 0], minlength=len(chunk)).astype(np.int64)
    return [words.counts, word_chars, n_symbols, n_dup_lines, n_repeat_words]


def sketches(words: Words, n: int) -> np.ndarray:
    """``SKETCH`` least hashes of the windows of five words of each of ``n`` texts; near copies share most of them. 0 where there is no window."""
    hashes, valid = words.windows(5)
    at = np.flatnonzero(valid)
    out = np.zeros((SKETCH, n), np.uint64)
    if len(at):
        docs, own = words.docs[at], hashes[at]
        heads = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
        for k in range(SKETCH):
            out[k, docs[heads]] = np.minimum.reduceat(mix(own ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)), heads)
    return out


def _places(chunk: packets.Chunk, name: int, lang: str) -> pa.RecordBatch:
    """A row for each pair of sketches of each text that passes the base rules, and one with the facts of the chunk."""
    counts, least = [], []
    for block in chunk.blocks():
        words = Words(block.data, block.offsets)
        counts.append(np.stack(base_counts(block, words)))
        least.append(sketches(words.of(lower_ascii(block.data)), len(block)))
    counts, least = np.concatenate(counts, axis=1), np.concatenate(least, axis=1)
    facts = Facts(np.concatenate([counts, least[:1].view(np.int64)]))
    rows = np.flatnonzero(~facts.failed)
    own = chunk.table[lang].to_pylist()
    tongue = np.array([xxhash.xxh3_64_intdigest(own[i] or "") for i in rows.tolist()], np.uint64)
    rank = np.array([xxhash.xxh3_64_intdigest(chunk.text(i)) for i in rows.tolist()], np.uint64)
    least = least[:, rows]
    with np.errstate(over="ignore"):
        keys = [mix(least[i] ^ mix(least[j] ^ mix(tongue + np.uint64(SKETCH * i + j)))) for i, j in _PAIRS]
    n = len(_PAIRS) * len(rows)
    columns = (
        pa.array(np.concatenate([*keys, np.zeros(1, np.uint64)]).view(np.int64)),
        pa.array(np.append(np.tile(rank.view(np.int64), len(_PAIRS)), 0)),
        pa.array(np.full(n + 1, name, np.int64)),
        pa.array(np.append(np.tile(rows, len(_PAIRS)), -1).astype(np.int32)),
        pa.array([None] * n + [facts.pack()], pa.binary()),
    )
    return pa.RecordBatch.from_arrays(list(columns), names=["key", "rank", "chunk", "place", "facts"])


def _learnt(places: DataFrame, apart: bool) -> DataFrame:
    """A row per chunk with two bits for each of its documents: whether the model learns it, and its fold.

    Texts of a language that share two of four sketches are copies or near copies; one shared window does not make them so. A text is learnt if none of
    lesser hash is its copy: the least of a group always is, and no other one that a lesser member matches. Equal texts go by chunk and place.
    """

    def bits(table: pa.Table) -> pa.Table:
        facts = Facts.unpack(next(f for f in table["facts"].to_pylist() if f is not None))
        flags = np.zeros(len(facts.sketch), bool)
        own = table["place"].to_numpy()
        flags[own[own >= 0]] = True
        packed = [pa.array([np.packbits(b).tobytes()], pa.binary()) for b in (flags, _folds(facts, apart) == 1)]
        return pa.table({"chunk": table["chunk"][:1], "taught": packed[0], "fold": packed[1]})

    none = F.lit(None).cast("binary").alias("facts")
    first = places.where("place >= 0").groupBy("key").agg(F.min(F.struct("rank", "chunk", "place")).alias("first")).select("first.*")
    won = first.groupBy("chunk", "place").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(_PAIRS)).select("chunk", "place", none)
    whole = won.unionByName(places.where("place < 0").select("chunk", "place", "facts"))
    return whole.groupBy("chunk").applyInArrow(bits, "chunk long, taught binary, fold binary")


def _folds(facts: Facts, apart: bool) -> np.ndarray:
    return (facts.sketch.view(np.uint64) >> np.uint64(32) & np.uint64(apart)).astype(np.int64)


def _flags(taught: bytes, fold: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a chunk's ``n`` rows: whether each is learnt, and its fold."""
    flags, folds = (np.unpackbits(np.frombuffer(b, np.uint8))[:n] for b in (taught, fold))
    return flags.astype(bool), folds.astype(np.int64)


def _short(values: np.ndarray) -> np.ndarray:
    """Single precision with 16 bits of fraction, off by 2 ** -17 of a value at most: the last byte takes next to no room in a packet."""
    return ((values.astype(np.float32).view(np.uint32) + np.uint32(0x40)) & np.uint32(0xFFFFFF80)).view(np.float32)


def discounts(counts_of_counts) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of 0, 1, 2 and 3 or more; usual fixed ones where an estimate is out of bounds."""
    n1, n2, n3, n4 = (float(x) for x in counts_of_counts)
    usual = np.array([0.0, 0.5, 1.0, 1.5])
    if min(n1, n2, n3) <= 0:
        return usual
    y = n1 / (n1 + 2 * n2)
    found = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.where((found > 0) & (found <= [0, 1, 2, 3]), found, usual)


def _counts_of_counts(numbers: np.ndarray) -> list[int]:
    return [int((numbers == k).sum()) for k in (1, 2, 3, 4)]


def _interpolate(number, total, ones, twos, more, discount, shorter):
    """(number less its discount + the discounted mass times the shorter context's probability) / total."""
    kept = np.maximum(number - discount[np.minimum(number, 3).astype(np.int64)], 0)
    mass = discount[1] * ones + discount[2] * twos + discount[3] * more
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total > 0, (kept + mass * shorter) / total, shorter)


class LowOrders:
    """Probabilities after two, one and no bytes, from how many bytes stand before each n-gram of three; at most 2 ** 24 of them.

    The tables hold the contexts that occur, so a language of few texts has small ones.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, upper: list[np.ndarray]):
        self.upper = upper  # discounts of the longer orders, longest first
        self.tables = {}
        for j in (2, 1, 0):
            contexts, _, *sums = group_sums(keys >> np.uint64(8), counts, counts == 1, counts == 2, counts >= 3)
            # the last place stands for contexts that do not occur
            self.tables[j] = (keys, counts, contexts, [np.append(x, 0) for x in sums], discounts(_counts_of_counts(counts)))
            keys, counts = add_up(keys & _MASK(j), np.ones(len(keys), np.int64))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Probability of each n-gram's last byte after the two bytes before it."""
        out = np.full(len(keys), 1 / 256)
        for j in (0, 1, 2):
            own, counts, contexts, sums, discount = self.tables[j]
            pairs = keys & _MASK(j + 1)
            at = look_up(contexts, np.arange(len(contexts)), pairs >> np.uint64(8), missing=len(contexts))
            out = _interpolate(look_up(own, counts, pairs), *(x[at] for x in sums), discount, out)
        return out


def _orders(keys: np.ndarray, counts: np.ndarray, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, n-grams, counts) from the longest order to four: its own counts, then from how many n-grams one longer each is the end."""
    for n in range(order, 3, -1):
        yield n, keys, counts
        keys, counts = add_up(keys & _MASK(n - 1), np.ones(len(keys), np.int64))


def _merge_model(asked: list[dict], order: int, languages: int, parts: int) -> Iterator[tuple]:
    """The merged model of a range as sorted arrays, its counts of counts, and its share of the n-grams of three bytes."""
    step, part = asked[0]["step"], asked[0]["part"]
    asked = list({p["chunk"]: p for p in asked}.values())  # chunks of one name are copies
    keys, counts = add_up(np.concatenate([packets.expand(p["keys"], np.uint64, rising=True) for p in asked]), np.concatenate([packets.expand(p["a"], np.uint32) for p in asked]).astype(np.int64))
    keys, counts = keys[counts > 0], counts[counts > 0]
    if not len(keys):
        return
    yield (step, part, 0, len(keys), packets.squeeze(keys, rising=True), packets.squeeze(counts), b"model", None)
    for n, own, number in _orders(keys, counts, order):
        for k, value in enumerate(_counts_of_counts(number)):
            yield (step + 2 * languages, 4 * (order - n) + k, value, 0, None, None, None, None)
        last = own
    low, number = add_up(last & np.uint64(0xFFFFFF), np.ones(len(last), np.int64))
    by, places = ngrams.by_context(low << np.uint64(16), parts)
    yield from packets.cut(step + languages, 0, low[by], places, a=number[by].astype(np.uint32))


def _merge_low(asked: list[dict]) -> Iterator[tuple]:
    keys, counts = add_up(np.concatenate([packets.expand(p["keys"], np.uint64, rising=True) for p in asked]), np.concatenate([packets.expand(p["a"], np.uint32) for p in asked]).astype(np.int64))
    yield (asked[0]["step"], asked[0]["part"], 0, len(keys), packets.squeeze(keys, rising=True), packets.squeeze(counts), None, None)


def probabilities(wanted: np.ndarray, keys: np.ndarray, counts: np.ndarray, order: int, low: LowOrders) -> np.ndarray:
    """Kneser-Ney probability of the last byte of each wanted n-gram; ``keys`` are all n-grams that share its three bytes before."""
    out = low(wanted)
    for (n, own, number), discount in reversed(list(zip(_orders(keys, counts, order), low.upper))):
        pairs = wanted & _MASK(n)
        above, _, total, ones, twos, more = group_sums(own >> np.uint64(8), number, number == 1, number == 2, number >= 3)
        of = lambda sums: look_up(above, sums, pairs >> np.uint64(8))  # noqa: E731, B023
        out = _interpolate(look_up(own, number, pairs), of(total), of(ones), of(twos), of(more), discount, out)
    return out


def _merge_answers(asked: list[dict], order: int, low: dict) -> Iterator[tuple]:
    model = next((p for p in asked if p["b"] is not None), None)
    keys = packets.expand(model["keys"], np.uint64, rising=True) if model else np.zeros(0, np.uint64)
    counts = packets.expand(model["a"], np.int64) if model else np.zeros(0, np.int64)
    for p in asked:
        if p["b"] is None:
            wanted = packets.expand(p["keys"], np.uint64, rising=True)
            values = _short(np.log10(probabilities(wanted, keys, counts, order, low[p["step"]])))
            yield (p["step"], p["part"], p["chunk"], p["n"], None, packets.squeeze(values), None, None)


class _Asked:
    """The n-grams of a chunk by model, with counts from the documents that are learnt: language c has the models 2 * c and 2 * c + 1, one a fold."""

    def __init__(self, chunk: packets.Chunk, learnt: np.ndarray, folds: np.ndarray, lang: str, order: int, codes: dict[str, int], parts: int):
        code = 2 * np.array([codes[x or ""] for x in chunk.table[lang].to_pylist()], np.int64) + folds
        self.groups = []
        for c in np.unique(code).tolist():
            rows = np.flatnonzero(code == c)
            texts = [lower_ascii(np.frombuffer(chunk.text(i), np.uint8)).tobytes() for i in rows.tolist()]
            taught, counts = ngrams.count([t for t, own in zip(texts, learnt[rows].tolist()) if own], order)
            others, _ = ngrams.count([t for t, own in zip(texts, learnt[rows].tolist()) if not own], order)
            keys, counts = add_up(np.concatenate((taught, others)), np.concatenate((counts, np.zeros(len(others), np.int64))))
            self.groups.append((c, rows, texts, keys, counts, *ngrams.by_context(keys, parts)))

    def rows(self, name: int) -> Iterator[tuple]:
        for c, _, _, keys, counts, by, places in self.groups:
            yield from packets.cut(c, name, keys[by], places, a=counts[by].astype(np.uint32))


def measure(docs: DataFrame, carry: list[str], id_col: str = "doc_id", text_col: str = "text", lang: str = "lang", order: int = ORDER, apart: bool = False) -> DataFrame:
    """Counts and log probability of every text: ``row`` (a struct of the columns in ``carry``), the base counts, ``base_failed``,
    ``language``, ``n_bytes``, ``log10_per_byte``: the mean log10 probability of its bytes and its end in its language's model; ``learnt``:
    whether the model learns this row (of copies and near copies it learns one); and ``fold``.

    With ``apart``, a language's texts fall into two folds by their first sketch, with a model each, and a text is scored by the model of the other
    fold: never by counts of its own, of its copies, or (but for the few whose first sketch differs) of its near copies. Else there is one fold.
    """
    parts = packets.ranges_for(docs, text_col)
    named = [r[0] for r in docs.select(F.coalesce(F.col(lang), F.lit("")).alias("l")).distinct().limit(LANGUAGES + 1).collect()]
    if len(named) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages: {lang} is no language column")
    codes = {x: i for i, x in enumerate(sorted(named))}
    n = max(2 * len(codes), 1)
    other = lambda step: step.bitwiseXOR(F.lit(int(apart)))

    def place(batches) -> Iterator[pa.RecordBatch]:
        for chunk in packets.chunks(batches, text_col):
            yield _places(chunk, chunk.name(id_col), lang)

    places = save(docs.mapInArrow(place, _PLACE), "op1-places")
    learnt = save(_learnt(places, apart), "op1-learnt")

    def ask(chunk: packets.Chunk, name: int, row: dict) -> Iterator[tuple]:
        return _Asked(chunk, *_flags(row["taught"], row["fold"], len(chunk)), lang, order, codes, parts).rows(name)

    texts = docs.select(*dict.fromkeys((id_col, text_col, lang)))
    asked = save(packets.requests_beside(texts, learnt, id_col, text_col, ask), "op1-asked")
    model = save(packets.answers(asked, lambda p: _merge_model(p, order, n, parts)), "op1-model")
    stats = {(r[0] - 2 * n, r[1]): r[2] for r in model.where(F.col("step") >= 2 * n).groupBy("step", "part").agg(F.sum("chunk")).collect()}
    low: dict[int, list] = {c: ([np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]) for c in range(n)}
    for r in packets.answers(model.where((F.col("step") >= n) & (F.col("step") < 2 * n)), _merge_low).collect():
        low[r["step"] - n][0].append(packets.expand(bytes(r["keys"]), np.uint64, rising=True))
        low[r["step"] - n][1].append(packets.expand(bytes(r["a"]), np.int64))
    upper = lambda c: [discounts([stats.get((c, 4 * j + k), 0) for k in range(4)]) for j in range(order - 3)]
    tables = docs.sparkSession.sparkContext.broadcast({c: LowOrders(*add_up(np.concatenate(k), np.concatenate(v)), upper(c)) for c, (k, v) in low.items()})
    bare = asked.withColumns({"step": other(F.col("step")), "a": F.lit(None).cast("binary")})  # the counts are in the model
    told = packets.answers(bare.unionByName(model.where(F.col("step") < n)), lambda p: _merge_answers(p, order, tables.value))
    none = F.lit(None).cast("binary")
    beside = lambda df, step, a, b: df.select(F.lit(step).alias("step"), F.lit(0).alias("part"), "chunk", F.lit(0).alias("n"), none.alias("keys"), a.alias("a"), b.alias("b"), none.alias("c"))
    known = beside(places.where("place < 0"), -1, F.col("facts"), none).unionByName(beside(learnt, -2, F.col("taught"), F.col("fold")))

    def use(chunk, name, found):
        if -1 not in found or -2 not in found:
            raise RuntimeError("an unknown chunk: the input changed between two reads")
        counts = Facts.unpack(found[-1][0]["a"])
        logs = np.zeros(len(chunk))
        taught, folds = _flags(found[-2][0]["a"], found[-2][0]["b"], len(chunk))
        own = _Asked(chunk, taught, folds, lang, order, codes, parts)
        for c, rows, texts, keys, _, by, places in own.groups:
            values = ngrams.answered(found, c ^ int(apart), by, places, np.float32)
            logs[rows] = ngrams.sums_per_text(texts, order, keys, values) / (np.array([len(t) for t in texts]) + 1)
        return pa.table({
            "row": packets.whole_rows(chunk.table.select(carry)),
            "n_words": counts.n_words, "word_chars": counts.word_chars, "n_symbols": counts.n_symbols, "n_dup_lines": counts.n_dup_lines,
            "n_repeat_words": counts.n_repeat_words, "base_failed": counts.failed,
            "language": pa.array([x or "" for x in chunk.table[lang].to_pylist()], pa.string()), "n_bytes": np.diff(chunk.offsets), "log10_per_byte": logs,
            "learnt": taught, "fold": folds,
        })

    fields = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, language string, n_bytes long, log10_per_byte double, learnt boolean, fold long"
    schema = T.StructType([T.StructField("row", docs.select(*carry).schema), *T.StructType.fromDDL(fields).fields])
    return packets.meet(packets.packs(docs, id_col, text_col), told.unionByName(known), text_col, use, schema)


def judge(measured: DataFrame, lower: float = LOWER, upper: float = UPPER, settle: int = SETTLE) -> DataFrame:
    """Adds ``perplexity`` (per byte), ``deviation``, the bounds ``least`` and ``most`` of its language's band, and ``kept``.

    The mean log probability of a short text scatters more. So its distance from the median log perplexity of its language (and fold: what one model scored) is
    taken times sqrt(bytes / (bytes + settle)). A band runs from ``lower`` spreads below to ``upper`` spreads above zero; the spread is half the
    distance from the 16th to the 84th percentile of the deviations. Median and spread are taken over the language's learnt documents, or over its
    base-passing ones where no column says which are learnt.

    A few documents say little of their language's spread, and the models learnt from them scatter more. So ``LEAST_SPREAD`` ** 2 / (number of documents)
    is added to the squared spread: a wide band for a handful of texts, next to nothing for thousands.
    """
    log = -F.col("log10_per_byte")
    model = ["language", "fold"] if "fold" in measured.columns else ["language"]
    passing = measured.where("learnt" if "learnt" in measured.columns else ~F.col("base_failed"))
    # the tables joined here have at most 2 * LANGUAGES rows, which measure() has checked
    middle = passing.groupBy(*model).agg(F.percentile_approx(log, 0.5, 10_000).alias("middle"))
    deviation = (log - F.col("middle")) * F.sqrt(F.col("n_bytes") / (F.col("n_bytes") + settle))
    marks = F.percentile_approx(deviation, F.array(F.lit(0.16), F.lit(0.84)), 10_000)
    half = (F.col("m")[1] - F.col("m")[0]) / 2
    spread = passing.join(F.broadcast(middle), model).groupBy("language").agg(marks.alias("m"), F.count(F.lit(1)).alias("n"))
    spread = spread.select("language", F.sqrt(half * half + LEAST_SPREAD**2 / F.col("n")).alias("s"))
    bands = spread.select("language", (-lower * F.col("s")).alias("least"), (upper * F.col("s")).alias("most"))
    judged = measured.join(F.broadcast(middle), model, "left").join(F.broadcast(bands), "language", "left")
    # a fold in which no text is learnt has nothing to be judged by
    judged = judged.withColumns({"perplexity": F.pow(F.lit(10.0), log), "deviation": F.coalesce(deviation, F.when(~F.col("base_failed"), 0.0))})
    inside = F.coalesce(F.col("deviation").between(F.col("least"), F.col("most")), F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & inside).drop("middle", "log10_per_byte", "learnt", "fold")


def quality_rules(docs: DataFrame, carry: list[str], id_col: str = "doc_id", text_col: str = "text", lang: str = "lang", order: int = ORDER, lower: float = LOWER, upper: float = UPPER, settle: int = SETTLE) -> DataFrame:
    """Base rules and language-specific perplexity bands; one row per input row, see ``measure`` and ``judge``.

    The model of each language is counted over its base-passing documents, one of each group of copies and near copies, with no pruning: n-grams of ``order`` bytes
    in sorted arrays by range, the lower orders by continuation counts, modified Kneser-Ney discounts per order. All n-grams
    with the same three bytes before the last are in one range, so a range has every context of three bytes or more in full.
    Shorter contexts go to every range; there are at most 2 ** 24 counts per model.
    Each language has two models, of one half of its documents each, and a text is scored by the half it is not in.

    A null or empty text has no words and fails the base rules. A null language is one of its own. Rows that repeat are
    learnt once and judged alike. Empty tables give empty results; columns outside ``carry`` are not in the result.
    """
    return judge(save(measure(docs, carry, id_col, text_col, lang, order, apart=True), "op1-measured"), lower, upper, settle)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return quality_rules(docs, ["doc_id"]).select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "perplexity", "kept")
