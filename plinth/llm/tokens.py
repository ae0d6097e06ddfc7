"""Token-ID output: Simple-8b word-aligned coding.

A 64-bit word has a selector in its top four bits and, below, as many ids of one
width as fit 60 bits.  Selector ``ESCAPE`` announces that the next word is one
whole 64-bit id, for ids of more than 60 bits.  The number of ids before each
group of ``GROUP`` words is stored beside the words, so that a reader finds any
id and decodes groups at once, vectorised.

A token file is a Parquet table of blocks in ascending document order: shard,
block, the number of the block's first id within the shard, document ids and
lengths, words and offsets.  It is written and read by Spark, in the folder that
all executors share.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.llm import common

#: Ids in a word and bits of each, by selector; the last is for escapes.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60, 64])
SINGLE, ESCAPE = 13, 15
GROUP = 128
#: Ids of a block, unless one document has more.
BLOCK_IDS = 1 << 16
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
#: Entries of a worker's cache of encoded pieces, and the most bytes of one.
CACHED, KEPT_BYTES = 400_000, 64
#: Bytes of texts that are cut into pieces at once.
CUT_BYTES = 1 << 22
#: The array type of 4-byte unsigned integers.
UNSIGNED = next(c for c in "IL" if array(c).itemsize == 4)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of unsigned 64-bit ids, greedily packed, and the ids before each group of words."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    #: Of each place, the selector of the word that would start there.
    best, top = np.full(n, ESCAPE, dtype=np.uint8), int(ids.max())
    for s in range(SINGLE, -1, -1):
        k, width = int(COUNTS[s]), int(WIDTHS[s])
        if k > n:
            break
        fits = ids < np.uint64(1 << width) if top >> width else np.ones(n, dtype=bool)
        run = 1
        while run < k:
            more = min(run, k - run)
            fits, run = fits[:-more] & fits[more:], run + more
        if not fits.any():
            # Then no word of more and narrower ids fits either.
            break
        best[: n - k + 1][fits] = s
    # The words' starts follow from each other; a chain of every 16th is followed one by one.
    after = np.append(np.minimum(np.arange(n) + COUNTS[best], n), n)
    jump = after
    for _ in range(4):
        jump = jump[jump]
    at, heads = 0, []
    while at < n:
        heads.append(at)
        at = jump.item(at)
    starts = [np.array(heads)]
    for _ in range(15):
        starts.append(after[starts[-1]])
    starts = np.stack(starts, axis=1).ravel()
    starts = starts[starts < n]
    chosen = best[starts]
    where = np.arange(len(starts)) + np.cumsum(chosen == ESCAPE) - (chosen == ESCAPE)
    words = np.zeros(len(starts) + int((chosen == ESCAPE).sum()), dtype=np.uint64)
    for s in np.unique(chosen):
        own = chosen == s
        if s == ESCAPE:
            words[where[own]] = np.uint64(ESCAPE) << np.uint64(60)
            words[where[own] + 1] = ids[starts[own]]
            continue
        shifts = (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64)
        packed = np.bitwise_or.reduce(ids[starts[own][:, None] + np.arange(COUNTS[s])] << shifts, axis=1)
        words[where[own]] = packed | (np.uint64(s) << np.uint64(60))
    before = np.zeros(len(words), dtype=np.int64)
    before[where] = starts
    before[where[chosen == ESCAPE] + 1] = starts[chosen == ESCAPE] + 1
    return words, before[::GROUP].astype(np.uint64)


def decode(words: np.ndarray) -> np.ndarray:
    """All ids of the words."""
    n = len(words)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(n, dtype=bool)
    if (selectors == ESCAPE).any():
        # A word after an escape is data, whatever it looks like.
        for i in np.flatnonzero(selectors == ESCAPE).tolist():
            if not raw[i] and i + 1 < n:
                raw[i + 1] = True
    counts = np.where(raw, 1, np.where(selectors == ESCAPE, 0, COUNTS[selectors]))
    starts = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), dtype=np.uint64)
    out[starts[raw]] = words[raw]
    for s in np.unique(selectors[~raw]):
        if s == ESCAPE:
            continue
        own = (selectors == s) & ~raw
        k, width = int(COUNTS[s]), int(WIDTHS[s])
        shifts, mask = (np.arange(k) * width).astype(np.uint64), np.uint64((1 << width) - 1)
        out[starts[own][:, None] + np.arange(k)] = (words[own][:, None] >> shifts) & mask
    return out


def decode_range(words: np.ndarray, offsets: np.ndarray, start: int, stop: int) -> np.ndarray:
    """The ids ``start`` to ``stop``, decoding only the groups that hold them."""
    a = max(0, int(np.searchsorted(offsets, start, side="right")) - 1)
    b = int(np.searchsorted(offsets, stop, side="left"))
    first = a * GROUP
    # A group may begin with the data word of an escape that ends the group before.
    if first and int(words[first - 1] >> np.uint64(60)) == ESCAPE and not _data(words, first - 1, a):
        first -= 1
    ids = decode(words[first : b * GROUP])
    skip = start - int(offsets[a]) if len(offsets) else 0
    return ids[skip : skip + stop - start]


def _data(words: np.ndarray, at: int, group: int) -> bool:
    """Whether a word that looks like an escape is the data of the one before."""
    n = 0
    while at - n - 1 >= 0 and int(words[at - n - 1] >> np.uint64(60)) == ESCAPE:
        n += 1
    return n % 2 == 1


class Pieces(dict):
    """Ids of pieces as bytes, made by ``make`` when first asked for; only short ones are kept.

    When half of what may be kept is new, the other half is given up but for the
    pieces that were asked for meanwhile.
    """

    def __init__(self, make: Callable[[bytes], bytes]):
        super().__init__()
        self.make, self.before = make, {}

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(piece) <= KEPT_BYTES:
            if 2 * len(self) >= CACHED:
                self.before = dict(self)
                self.clear()
            self[piece] = ids
        return ids


#: Kinds of bytes in lower-cased texts of Latin-1 letters, digits, ASCII punctuation and white space, as UTF-8: there all from 128 on are of letters.
SPACE, LETTER, DIGIT, OTHER = range(4)
KINDS = np.array([SPACE if 9 <= b <= 13 or b == 32 else LETTER if 97 <= b <= 122 or b >= 128 else DIGIT if 48 <= b <= 57 else OTHER for b in range(256)], dtype=np.uint8)
#: Lower-cases such texts: of a two-byte letter the second byte tells the case.
LOWER = bytes(b + 32 if 65 <= b <= 90 or 0x80 <= b <= 0x9E else b for b in range(256))


def piece_starts(data: np.ndarray) -> np.ndarray:
    """Where the pieces and runs of white space begin in the bytes of such lower-cased texts, which end with three of white space.

    A piece is a run of letters, a digit, a run of other characters, or one of
    's 't 're 've 'm 'll 'd whose apostrophe begins a run.
    """
    kind = KINDS[data]
    new = np.empty(len(data), dtype=bool)
    new[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new |= kind == DIGIT
    quotes = np.flatnonzero((data == ord("'")) & new)
    first, second = data[quotes + 1], data[quotes + 2]
    short = np.isin(first, list(b"stmd"))
    long = (second == ord("e")) & np.isin(first, list(b"rv")) | (first == ord("l")) & (second == ord("l"))
    new[quotes[short | long] + 1] = False
    new[quotes[short] + 2] = True
    new[quotes[long] + 3] = True
    return np.flatnonzero(new)


#: The rules that ``Encoder`` cuts texts by.  Fixed values: normaliser and pre-tokeniser of ``word_bpe_49k.json``.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}


def known_rules(path: str) -> bool:
    """Whether a tokenizer file cuts texts by the rules above and has no special tokens but those that begin with ``<|``."""
    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    special = all(t["content"].startswith("<|") for t in rules.get("added_tokens") or ())
    return special and rules.get("normalizer") == NORMALIZER and rules.get("pre_tokenizer") == PRE_TOKENIZER and rules.get("post_processor") is None


class Encoder:
    """Ids by the tokenizers library, with the ids of frequent pieces kept.

    A file of other rules than ``known_rules`` gets whole texts.  Else the tokenizer drops white space and never joins characters across it, so a
    text's ids are those of its words.  Texts of Latin-1 letters, digits, ASCII
    punctuation and white space are cut into pieces here by the tokenizer's own
    rule, many texts at a time, and each different piece is encoded by its model.
    In other texts that is done word by word, and a word of other characters, or
    one that holds the beginning of a special token, is encoded whole by the library.
    """

    PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.known = known_rules(path)
        self.pieces, self.words = Pieces(self.piece), Pieces(self.whole)
        # Printable bytes stand for themselves, the others for characters from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.shown = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}

    def piece(self, piece: bytes) -> bytes:
        if piece.isspace():
            return b""
        mapped = piece.decode() if piece.isascii() else piece.decode("latin-1").translate(self.shown)
        return array(UNSIGNED, [t.id for t in self.tokenize(mapped)]).tobytes()

    def whole(self, word: bytes) -> bytes:
        return array(UNSIGNED, self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def plain(self, text: bytes) -> bool:
        return b"<|" not in text and self.PLAIN.fullmatch(text.decode()) is not None

    def cut(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each of some plain texts."""
        data = b"\n".join([*texts, b"\n\n"]).translate(LOWER)
        starts = piece_starts(np.frombuffer(data, dtype=np.uint8))
        ends = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
        found = list(map(self.pieces.__getitem__, pieces.dictionary.to_numpy(zero_copy_only=False).tolist()))
        ids, lengths = np.frombuffer(b"".join(found), dtype="<u4"), np.fromiter(map(len, found), np.int32, len(found)) // 4
        which = pieces.indices.to_numpy()
        n = lengths[which]
        after = np.cumsum(n, dtype=np.int32)
        made = ids[np.repeat((np.cumsum(lengths, dtype=np.int32) - lengths)[which] - after + n, n) + np.arange(after[-1], dtype=np.int32)]
        # White space before a text belongs to a run that began earlier, and has no ids.
        begins = np.cumsum([0, *(len(x) + 1 for x in texts)])
        at = np.append(0, after)[np.searchsorted(starts, begins)].tolist()
        return [made[a:b] for a, b in zip(at, at[1:])]

    def cut_all(self, texts: Iterable[bytes]) -> Iterator[np.ndarray]:
        """The same, some ``CUT_BYTES`` at a time, to bound what is held; longer texts are parted before white space."""
        held, size = [], 0
        for text in texts:
            if size + len(text) > CUT_BYTES:
                yield from self.cut(held)
                held, size = [], 0
            if len(text) > CUT_BYTES:
                parts = re.findall(rb"(?s:.{1,%d})[^\t-\r ]*" % CUT_BYTES, text)
                yield np.concatenate([self.cut([x])[0] for x in parts])
            else:
                held.append(text)
                size += len(text)
        yield from self.cut(held)

    def mixed(self, text: bytes) -> np.ndarray:
        """The ids of a text that isn't plain."""
        words = text.split()
        plain = [self.plain(w) for w in words]
        own = self.cut_all(w for w, p in zip(words, plain) if p)
        return np.concatenate([np.empty(0, "<u4"), *(next(own) if p else np.frombuffer(self.words[w], dtype="<u4") for w, p in zip(words, plain))])

    def encode_all(self, texts: list[bytes]) -> list[np.ndarray]:
        if not self.known:
            return [np.frombuffer(self.whole(x), dtype="<u4") for x in texts]
        plain = [self.plain(x) for x in texts]
        own = self.cut_all(x for x, p in zip(texts, plain) if p)
        return [next(own) if p else self.mixed(x) for x, p in zip(texts, plain)]

    def encode(self, text: bytes) -> np.ndarray:
        return self.encode_all([text])[0]


def encoder_of(path: str) -> Encoder:
    """The encoder of this Python process, kept with its cache for the tasks to come."""
    kept = common.kept()
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


_BLOCKS = T.StructType([
    T.StructField("shard", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("first_id", T.LongType()),
    T.StructField("n_ids", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.LongType())),
    T.StructField("words", T.BinaryType()), T.StructField("offsets", T.BinaryType()),
])


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """The documents' ids in blocks: shards are ranges of document ids, and each ascends within itself."""
    spark = docs.sparkSession
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    low = F.lit(-(1 << 63)).cast("long")
    df = docs.select(F.coalesce(docs[id_col].cast("long"), low).alias("doc"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    parts = common.parts_for(spark)
    points = common.split_points(df.select("doc"), "doc", parts)
    df = df.withColumn("shard", common.range_of(F.col("doc"), points)).repartition(parts, "shard").sortWithinPartitions("shard", "doc", "text")
    arrow = common.to_arrow(_BLOCKS)
    common.small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_of(path), np.array([end_id], dtype="<u4")
        shard, block, first, n, docs, held = None, 0, 0, 0, [], []

        def made() -> pa.RecordBatch:
            words, offsets = encode(np.concatenate(held))
            row = (shard, block, first, n, docs, [len(x) for x in held], words.astype("<u8").tobytes(), offsets.astype("<u8").tobytes())
            return pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(row, arrow)], schema=arrow)

        for batch in common.pieces(batches):
            encoded = encoder.encode_all(common.utf8(batch.column("text")))
            for own, doc, ids in zip(batch.column("shard").to_pylist(), batch.column("doc").to_pylist(), encoded):
                ids = np.concatenate((ids, end))
                if held and (own != shard or n + len(ids) > BLOCK_IDS):
                    yield made()
                    block, first = block + 1, first + n
                    n, docs, held = 0, [], []
                if own != shard:
                    shard, block, first = own, 0, 0
                docs.append(None if doc == -(1 << 63) else doc)
                held.append(ids)
                n += len(ids)
        if held:
            yield made()

    return df.mapInArrow(run, _BLOCKS)


def write(docs: DataFrame, where: str, **options) -> None:
    blocks(docs, **options).write.mode("overwrite").parquet(where)


_READ = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def read_ids(spark: SparkSession, where: str) -> DataFrame:
    """doc_id and ids (array) of each document of a token file."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType()))])

    def run(batch: pa.RecordBatch) -> dict:
        out: dict = {"doc_id": [], "ids": []}
        for docs, lengths, words in zip(*(batch.column(c).to_pylist() for c in ("doc_ids", "lengths", "words"))):
            ids, at = decode(np.frombuffer(words, dtype="<u8")), 0
            for doc, n in zip(docs, lengths):
                out["doc_id"].append(doc)
                out["ids"].append(ids[at : at + n].astype(np.int64))
                at += n
        return out

    return common.map_arrow(spark.read.parquet(where), run, schema)


def read_window(spark: SparkSession, where: str, begin: int, length: int) -> DataFrame:
    """doc_id, n_tokens and ids: of each document of a token file, its ``length`` ids from ``begin`` on, or as many as it has there.

    The offsets of a block lead to the words that hold these ids; no others are decoded.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType()))])

    def run(batch: pa.RecordBatch) -> dict:
        out: dict = {"doc_id": [], "n_tokens": [], "ids": []}
        for docs, lengths, words, offsets in zip(*(batch.column(c).to_pylist() for c in ("doc_ids", "lengths", "words", "offsets"))):
            coded, places, at = np.frombuffer(words, dtype="<u8"), np.frombuffer(offsets, dtype="<u8"), 0
            for doc, n in zip(docs, lengths):
                low, high = at + min(begin, n), at + min(begin + length, n)
                out["doc_id"].append(doc)
                out["n_tokens"].append(n)
                out["ids"].append(decode_range(coded, places, low, high).astype(np.int64) if high > low else [])
                at += n
        return out

    return common.map_arrow(spark.read.parquet(where).select("doc_ids", "lengths", "words", "offsets"), run, schema)


def read_back(spark: SparkSession, where: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document of a token file.

    ``start`` is the number of ids of all documents before it: in lower shards,
    from a sum for each shard, and in its own.
    """

    def run(batch: pa.RecordBatch) -> dict:
        out: dict = {f.name: [] for f in _READ}
        for shard, first, docs, lengths, words in zip(*(batch.column(c).to_pylist() for c in ("shard", "first_id", "doc_ids", "lengths", "words"))):
            raw, at = decode(np.frombuffer(words, dtype="<u8")).astype("<u4"), 0
            for doc, n in zip(docs, lengths):
                out["shard"].append(shard)
                out["doc_id"].append(doc)
                out["start"].append(first + at)
                out["n_tokens"].append(n)
                out["ids_crc32"].append(zlib.crc32(raw[at : at + n].tobytes()))
                at += n
        return out

    file = spark.read.parquet(where)
    # As many rows as shards.
    sums = file.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    before, total = [], 0
    for r in sums:
        before.append((r["shard"], total))
        total += r["n"]
    offsets = F.broadcast(spark.createDataFrame(before, "shard int, before long"))
    found = common.map_arrow(file.select("shard", "first_id", "doc_ids", "lengths", "words"), run, _READ)
    return found.join(offsets, "shard").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Write ``docs`` as a token file in the shared folder and return what reading it back gives.

    Ids are integers.  Null and empty texts have the end id alone.  Rows that
    share an id are written one after another, by their texts; rows without an
    id come first.  An empty table gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    where = common.scratch(spark, "tokens")
    write(docs, where, id_col=id_col, text_col=text_col, path=path)
    return read_back(spark, where)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.table(spark, sf_dir, "documents"))
