"""Token files: documents as ids of a public tokenizer, in order, range-coded.

A file is a table of blocks, ordered by ``part`` and ``block``: the documents'
keys and lengths, the number of ids before the block in its part, and the ids
of whole documents, coded on their own (rangecoder). A block closes once it has
``block_ids`` ids. Blocks carry checksums; reading a damaged one fails.

The library encodes each distinct piece of a task once. A text is cut only where
the tokenizer's pattern always starts a new word, whatever stands around (see
``_cuts``), so the ids are those of the whole text.

Defined results: null and empty texts have only the end id; rows without key
come first; rows that repeat a key stay, next to each other, ordered by text.
An empty table gives files without blocks.
"""

from __future__ import annotations

import zlib
from array import array
from functools import lru_cache
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationlake.llm.rangecoder import decode_block, encode_block

#: A byte-level vocabulary writes each byte as a visible character: itself, or one from U+0100 on.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_VISIBLE = {b: chr(b) for b in _PLAIN} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in set(_PLAIN))}
_LINED = _VISIBLE | {0x0A: "\n"}
#: Classes of bytes: letters, marks, digits, space, line end, other white space, what is not told apart, and the
#: last byte of wide white space. An apostrophe is not told apart, as it may belong to the letters behind it.
_LETTER, _MARK, _DIGIT, _SPACE, _LINE, _WHITE, _OTHER, _WIDE = range(8)
_CLASS = np.full(256, _OTHER, np.uint8)
for _c in range(128):
    _CLASS[_c] = (
        _LETTER if chr(_c).isalpha() else _DIGIT if chr(_c).isdigit() else _SPACE if _c == 0x20 else _LINE if _c == 0x0A
        else _WHITE if chr(_c).isspace() else _MARK if 0x20 < _c < 0x7F and _c != 0x27 else _OTHER
    )
#: U+00C0 to U+024F, whose two bytes begin with these, are letters, two signs excepted.
_CLASS[0xC3:0xCA] = _LETTER
_TOLD = (_LETTER, _MARK, _DIGIT)
_STARTS = np.zeros((8, 8), bool)
_STARTS[[*_TOLD, _OTHER], _SPACE] = True
_WIDE_SPACES = [int.from_bytes(chr(c).encode()) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_SPACES = _STARTS.ravel().copy()
_STARTS[[*_TOLD, _OTHER], _LINE] = True
for _a in _TOLD:
    # After a line end only where no white space stands before it, which _cuts checks.
    _STARTS[[a for a in (*_TOLD, _LINE) if a != _a], _a] = True
_STARTS = _STARTS.ravel()
_AFTER_LINE = np.isin(np.arange(64), [8 * _LINE + a for a in _TOLD])
#: As tables of bytes.translate, several times as fast as indexing: classes, and by pair of them 1 where a word starts,
#: with 2 where that hangs on what stands before the line end.
_CLASSES = _CLASS.tobytes()
_PAIRS = (_STARTS + 2 * _AFTER_LINE).astype(np.uint8).tobytes().ljust(256, b"\0")
_SPACE_PAIRS = _SPACES.tobytes().ljust(256, b"\0")
BLOCKS = "part int, block int, first long, doc_ids array<long>, lengths array<long>, data binary"


def _cuts(data: np.ndarray, spaces_only: bool) -> np.ndarray:
    """Whether the pattern of a byte-level tokenizer starts a new word at each byte, or False where that is open.

    It does between letters, marks and digits, and before white space that follows
    something else; after a single line end as well. With ``spaces_only`` just
    before a space that follows something else than white space.
    """
    kind = np.frombuffer(bytearray(data.tobytes().translate(_CLASSES)), np.uint8)
    # Second bytes of letters, and the last bytes of white space.
    begin = np.flatnonzero(data >= 0xC2)
    if len(begin):
        lead, second, third = (data.take(begin + i, mode="clip").astype(np.int32) for i in range(3))
        letter = (lead >= 0xC3) & (lead <= 0xC9) & ~((lead == 0xC3) & ((second == 0x97) | (second == 0xB7)))
        kind[begin] = np.where(letter, _LETTER, _OTHER)
        kind[begin[letter] + 1] = _LETTER
        kind[begin[np.isin(lead << 8 | second, _WIDE_SPACES)] + 1] = _WIDE
        kind[begin[np.isin(lead << 16 | second << 8 | third, _WIDE_SPACES)] + 2] = _WIDE
    pair = kind[:-1] << 3
    pair |= kind[1:]
    found = np.frombuffer(pair.tobytes().translate(_SPACE_PAIRS if spaces_only else _PAIRS), np.uint8)
    cut = np.zeros(len(data), bool)
    cut[1:] = (found & 1).view(bool)
    if not spaces_only:
        line = np.flatnonzero((found >> 1).view(bool)) + 1
        cut[line[~cut[line - 1]]] = False
    return cut


class Encoder:
    """Ids of texts by a tokenizers file.

    Keeps the ids of distinct pieces; beyond ``most`` pieces those seen once go.
    Pieces of letters alone need no splitting, so the library's model gets them
    directly, many in one call; all others pass its whole chain.
    """

    def __init__(self, tokenizer_file: str, most: int = 250_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most = Tokenizer.from_file(tokenizer_file), most
        self.model, self.vocabulary = self.tokenizer.model, self.tokenizer.get_vocab_size()
        # The model alone, on visible letters with spaces between the pieces.
        self.letters = Tokenizer(self.model)
        self.letters.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.leads = np.zeros(self.vocabulary, bool)
        self.leads[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith(_VISIBLE[0x20])]] = True
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()
        # A line end, and one or two marks behind a word: 43 entries at most.
        self.marks: dict[str, list[int]] = {}
        self.direct = True
        self.direct = self._is_byte_level()
        self._clear()

    def _clear(self) -> None:
        # The first entry is the end id's.
        self.table: dict[str, int] = {}
        self.flat, self.at, self.hits = array("i", [0]), array("q", [0, 1]), np.zeros(1, np.int64)

    def _is_byte_level(self) -> bool:
        """Whether the direct way is known to give the ids of the whole chain."""
        tried = [" the", " Wörter", "été", " a", " 日本", " x.", " straße,!", " x.\nÜber", "a\nb,\nc"]
        whole = [e.ids for e in self.tokenizer.encode_batch_fast(tried, add_special_tokens=False)]
        if whole != [self._directly(w) for w in tried]:
            return False
        shown = "".join(map(chr, range(0x20, 0x7F)))
        tried += [*(f"a{c}a 1{c}1\n{c}é{c} {c}.{c},{c}\n" for c in shown), "a×b÷c ß\n\nb \n c", shown]
        whole = [i for e in self.tokenizer.encode_batch_fast(tried, add_special_tokens=False) for i in [*e.ids, 0]]
        return self(tried, 0)[0].tolist() == whole

    def _directly(self, word: str) -> list[int] | None:
        ids: list[int] = []
        for i, line in enumerate(word.split("\n")):
            letters = line.rstrip(".,;:!?")
            if not letters[(not i) and letters.startswith(" ") :].isalpha():
                return None
            if i:
                ids += self._of_marks(_VISIBLE[0x0A])
            # ASCII letters are visible as they are.
            visible = letters.replace(" ", _VISIBLE[0x20]) if letters.isascii() else letters.encode().decode("latin-1").translate(_VISIBLE)
            ids += [t.id for t in self.model.tokenize(visible)]
            if len(letters) < len(line):
                ids += self._of_marks(line[len(letters) :])
        return ids

    def _of_marks(self, marks: str) -> list[int]:
        ids = self.marks.get(marks)
        if ids is None:
            ids = [t.id for t in self.model.tokenize(marks)]
            if len(marks) <= 2:
                self.marks[marks] = ids
        return ids

    def _of_letters(self, pieces: list[str], spaced: bool, at_once: int = 500) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of letters alone, all with or all without a space before them, and the number of ids of each."""
        ids, sizes, space = [np.empty(0, np.int32)], [np.empty(0, np.int64)], _VISIBLE[0x20]
        for begin in range(0, len(pieces), at_once):
            # Each piece, or a lone space behind it, gives the one token that leads with a space.
            visible = "\n".join(pieces[begin : begin + at_once])
            visible = visible.replace(" ", space) if visible.isascii() else visible.encode().decode("latin-1").translate(_LINED)
            visible = visible.replace("\n", " ") if spaced else visible.replace("\n", f" {space} ") + f" {space}"
            got = np.array(self.letters.encode_batch_fast([visible], add_special_tokens=False)[0].ids, np.int32)
            lead = np.flatnonzero(self.leads[got])
            sizes.append(np.diff(np.append(lead, len(got))) if spaced else np.diff(np.append(-1, lead)) - 1)
            ids.append(got if spaced else np.delete(got, lead))
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, pieces: list[str]) -> np.ndarray:
        """New entries, for pieces without one."""
        many, none = len(pieces), np.zeros(len(pieces), bool)
        letters = np.fromiter(map(str.isalpha, map(str.removeprefix, pieces, repeat(" "))), bool, many) if self.direct else none
        lead = np.fromiter(map(str.startswith, pieces, repeat(" ")), bool, many)
        kinds = letters & lead, letters & ~lead, ~letters
        spaced, bare, others = (list(compress(pieces, k.tolist())) for k in kinds)
        found = [e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)] if others else []
        parts = [self._of_letters(spaced, True), self._of_letters(bare, False)]
        sizes = np.concatenate([n for _, n in parts] + [np.fromiter(map(len, found), np.int64, len(found))])
        known, base = len(self.at) - 1, len(self.flat)
        self.table.update(zip(spaced + bare + others, range(known, known + len(pieces))))
        for ids, _ in parts:
            self.flat.frombytes(ids.tobytes())
        for ids in found:
            self.flat.extend(ids)
        self.at.frombytes((base + np.cumsum(sizes)).tobytes())
        entries = np.empty(many, np.int64)
        entries[np.concatenate([np.flatnonzero(k) for k in kinds])] = np.arange(known, known + many)
        return entries

    def _forget(self) -> None:
        """Keep the pieces seen more than once, or none if these are too many as well."""
        keep = self.hits > 1
        if 2 * int(keep.sum()) > self.most:
            keep[:] = False
        keep[0] = True
        new = np.cumsum(keep) - 1
        new, kept = new.tolist(), keep.tolist()
        self.table = {p: new[i] for p, i in self.table.items() if kept[i]}
        flat, at = np.frombuffer(self.flat, np.int32), np.frombuffer(self.at, np.int64)
        size = np.diff(at)
        kept = flat[np.repeat(keep, size)]
        ends = np.concatenate(([0], np.cumsum(size[keep])))
        del flat, at
        self.flat, self.at = array("i", kept.astype(np.int32).tobytes()), array("q", ends.astype(np.int64).tobytes())
        self.hits = self.hits[keep]

    def _places(self, pieces: list[str]) -> np.ndarray:
        """Entries of distinct pieces."""
        places = np.fromiter(map(self.table.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(places < 0)
        if len(new):
            places[new] = self._learn([pieces[i] for i in new.tolist()])
        return places

    def __call__(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, the end id after each text, and the number of ids of each."""
        if len(self.at) - 1 > self.most:
            self._forget()
        raw = b"".join([t.encode() for t in texts])
        data = np.frombuffer(raw, np.uint8)
        bounds = np.concatenate(([0], np.cumsum(np.fromiter((len(t) if t.isascii() else len(t.encode()) for t in texts), np.int64, len(texts)))))
        cut = _cuts(data, not self.direct) if len(raw) else np.zeros(0, bool)
        for token in self.added:
            # Tokens of their own are found before the pattern applies.
            place = raw.find(token)
            while place >= 0:
                cut[place + 1 : place + len(token)] = False
                place = raw.find(token, place + 1)
        cut[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        starts = np.flatnonzero(cut)
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(raw))), pa.py_buffer(raw)).dictionary_encode()
        counts = np.diff(np.searchsorted(starts, bounds))
        index = self._places(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())[pieces.indices.to_numpy()]
        known = len(self.at) - 1
        self.hits = np.concatenate((self.hits, np.zeros(known - len(self.hits), np.int64))) + np.bincount(index, minlength=known)
        self.flat[0] = end
        flat, at = np.frombuffer(self.flat, np.int32), np.frombuffer(self.at, np.int64)
        # The end id's entry behind each text.
        last = np.cumsum(counts)
        index = np.insert(index, last, 0)
        last += np.arange(len(texts))
        out, ends = [np.empty(0, np.int32)], np.empty(len(index), np.int64)
        # Some pieces at a time, as arrays of all ids do not fit the processor's cache.
        for begin in range(0, len(index), 1 << 14):
            part = index[begin : begin + (1 << 14)]
            first = at.take(part)
            size = at.take(part + 1)
            size -= first
            stop = np.cumsum(size, out=ends[begin : begin + len(part)])
            first += size
            first -= stop
            source = np.repeat(first, size)
            source += np.arange(len(source))
            out.append(flat.take(source))
            stop += ends[begin - 1] if begin else 0
        return np.concatenate(out), np.diff(ends[last], prepend=0)


@lru_cache(maxsize=1)
def encoder(tokenizer_file: str, most: int = 250_000) -> Encoder:
    """One encoder for all tasks of a worker process: it knows most pieces by then."""
    return Encoder(tokenizer_file, most)


def _writer(tokenizer_file: str, end: int, block_ids: int, at_once: int = 4 << 20):
    def run(batches):
        encode = encoder(tokenizer_file, 1_000_000)
        part, block, first = TaskContext.get().partitionId(), 0, 0
        keys, lengths, held = [], [], []

        def close():
            nonlocal block, first
            ids = np.concatenate(held)
            row = (part, block, first, list(keys), list(lengths), encode_block(ids, encode.vocabulary))
            block, first = block + 1, first + len(ids)
            keys.clear(), lengths.clear(), held.clear()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([row[0]], pa.int32()), pa.array([row[1]], pa.int32()), pa.array([row[2]], pa.int64()),
                    pa.array([row[3]], pa.list_(pa.int64())), pa.array([row[4]], pa.list_(pa.int64())), pa.array([row[5]], pa.binary()),
                ],
                names=["part", "block", "first", "doc_ids", "lengths", "data"],
            )

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            column = batch.column("text")
            # Some texts at a time: as Python strings they take up to four times their bytes.
            group = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // at_once
            edges = [*np.flatnonzero(np.diff(group, prepend=-1)).tolist(), len(names)]
            for begin, until in zip(edges, edges[1:]):
                texts = [t or "" for t in column.slice(begin, until - begin).to_pylist()]
                ids, n = encode(texts, end)
                bounds = np.cumsum(n)
                at = 0
                while at < len(n):
                    # Documents up to the one that fills the block.
                    room = block_ids - sum(map(len, held))
                    base = int(bounds[at - 1]) if at else 0
                    to = min(int(np.searchsorted(bounds, base + room)) + 1, len(n))
                    held.append(ids[base : int(bounds[to - 1])])
                    keys.extend(names[begin + at : begin + to])
                    lengths.extend(n[at:to].tolist())
                    at = to
                    if sum(map(len, held)) >= block_ids:
                        yield close()
        if held:
            yield close()

    return run


def write(
    docs: DataFrame, path: str, tokenizer_file: str, end: int = 0, key: str = "doc_id", text: str = "text", block_ids: int = 1 << 20
) -> None:
    """Encode the documents in ascending order of their key into a token table at ``path``."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_writer(tokenizer_file, end, block_ids), BLOCKS).write.option("compression", "none").parquet(path)


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``start``, the number of ids in all blocks before."""
    table = spark.read.schema(BLOCKS).parquet(path)
    # One row for each file written.
    sizes = table.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n)).alias("ids"))
    before = sizes.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    return table.join(before, "part").withColumn("start", F.col("before") + F.col("first")).drop("before", "first")


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and ``ids`` of every document of a token table."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_block(row["data"]).astype("<u4")
                n = np.array(row["lengths"], np.int64)
                bounds = np.concatenate(([0], np.cumsum(n)))
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + bounds[:-1]), pa.array(n), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    found = blocks(spark, path).select("start", "doc_ids", "lengths", "data")
    return found.mapInArrow(run, schema)
