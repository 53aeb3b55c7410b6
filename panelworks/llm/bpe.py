"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last bytes cuts each text where the hash meets a mask, so equal passages of
different documents fall into equal chunks wherever they stand. A chunk is encoded once per worker
and reused from a bounded cache. Cuts may fall anywhere, also inside a word: the pieces of the words
around a cut are put together and re-encoded. A join is repaired from the last white space before
the cut to the first after it; when a chunk holds none the repair takes in the next chunk as well,
until both sides end at white space. There the result agrees with that for the whole text exactly,
as the vocabulary's pre-tokenizer drops white space and no token spans it.

Chunks never met before are encoded word by word with the same reuse one level down: a word is the
shortest chunk that needs no repair, and only new words reach the tokenizers library, in batches.
Reuse is per worker and not across the cluster: carrying each chunk's tokens back to the documents
would shuffle more bytes than the whole texts hold.

The decoder is the library's: this vocabulary has none, so tokens are joined by spaces and chunks
are decoded once as well.

Defined results: a null text is the empty text, with no tokens. Repeated rows are encoded alike, null
ids keep their row, other columns are ignored. Texts are encoded whole at any length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 8  # bytes the rolling hash sees
MASK = (1 << 8) - 1  # a cut every 256 bytes on average
MAX_CHUNKS = 20_000  # cached per worker; about 25 MB
MAX_WORDS = 400_000  # cached per worker; about 80 MB
MAX_BATCH_BYTES = 8 << 20  # encoded bytes handed to Spark at once
_SPACE = (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")  # ASCII white space, at which a join ends
_CLOSING = b".,;:!?%&*$#"
# Composed lower-case Latin letters: unchanged by the vocabulary's normaliser, one run of letters.
_LATIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")


def _byte_names() -> dict[int, str]:
    """Byte-level vocabularies name printable bytes by themselves and the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE_NAMES = _byte_names()
_GEAR = np.random.default_rng(5).integers(0, 1 << 32, 256, dtype=np.uint32)


def word_bpe_path() -> str:
    """The public vocabulary's file on the machine that runs the task."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cuts(data: bytes) -> list[int]:
    """Offsets at which the rolling hash cuts ``data``, without both ends."""
    if len(data) <= WINDOW:
        return []
    g = _GEAR[np.frombuffer(data, dtype=np.uint8)]
    h = g[WINDOW - 1 :].copy()
    for back in range(1, WINDOW):
        h += g[WINDOW - 1 - back : len(g) - back] << np.uint32(back)
    return (np.flatnonzero((h >> np.uint32(12)) & np.uint32(MASK) == 0) + WINDOW).tolist()


class ChunkCoder:
    """Encodes texts through caches of chunks and words; a code is ids as little-endian 32-bit bytes."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # Plain words need none of the normaliser's work: the same model over words alone.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = WhitespaceSplit()
        size = self.tokenizer.get_vocab_size()
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.names = np.array([n.encode() for n in names], dtype=object)
        self.closes = np.array([n.endswith("</w>") for n in names])
        self.words: dict[bytes, bytes] = {}
        self.chunks: dict[bytes, bytes] = {}

    def learn(self, words: set[bytes]) -> None:
        """Encode new words, with one call of the library for plain ones and one for the others.

        Upper case and closing punctuation do not reach the library twice: the vocabulary is lower
        case, and punctuation after an ASCII letter or digit is always a token of its own.
        """
        known = self.words
        if len(known) > MAX_WORDS:
            known.clear()
        split: dict[bytes, tuple[bytes, bytes]] = {}
        for w in words:
            low = w if b"<" in w else w.lower()  # special tokens are written in lower case
            stem = low.rstrip(_CLOSING)
            if len(stem) == len(low) or not stem[-1:].isalnum():
                stem = low
            split[w] = (stem, low[len(stem) :])
        plain, mapped, other = [], [], []
        for p in {p for parts in split.values() for p in parts if p and p not in known}:
            if p.isalpha():  # ASCII letters
                plain.append(p)
                mapped.append(p.decode())
            elif _LATIN.fullmatch(t := p.decode()):
                plain.append(p)
                mapped.append(p.decode("latin-1").translate(_BYTE_NAMES))
            else:
                other.append(p)
        if plain:
            ids = np.array(self.plain.encode_batch_fast([" ".join(mapped)], add_special_tokens=False)[0].ids, dtype="<u4")
            code, last = ids.tobytes(), 0
            for p, end in zip(plain, (4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist(), strict=True):
                known[p] = code[last:end]
                last = end
        if other:
            codes = self.tokenizer.encode_batch_fast([p.decode() for p in other], add_special_tokens=False)
            known.update((p, np.array(c.ids, dtype="<u4").tobytes()) for p, c in zip(other, codes))
        for w, (stem, rest) in split.items():
            known[w] = known[stem] + known[rest] if rest else known[stem]

    def decode(self, code: bytes) -> bytes:
        """The text the library decodes the ids to: the vocabulary has no decoder, names are joined."""
        return b" ".join(self.names[np.frombuffer(code, dtype="<u4")].tolist())

    def encode(self, data: bytes) -> bytes:
        """Code of a whole text in UTF-8."""
        spans: list[tuple[bytes, bool]] = []  # bytes between white space, and whether they are a chunk
        waiting = b""  # bytes before a cut, up to the white space after it
        low = 0
        for high in [*cuts(data), len(data)]:
            chunk = data[low:high]
            first, last = _edges(chunk)
            if first < 0:  # no white space: the join goes on
                waiting += chunk
            else:
                spans.append((waiting + chunk[:first], False))
                spans.append((chunk[first : last + 1], True))
                waiting = chunk[last + 1 :]
            low = high
        spans.append((waiting, False))
        get = self.words.get
        out: list[bytes | None] = []
        todo = []
        missing: set[bytes] = set()
        for span, whole in spans:
            code = self.chunks.get(span) if whole else None
            if code is None:
                parts = span.split()  # bytes: at ASCII white space only
                codes = list(map(get, parts))
                if None in codes:
                    todo.append((len(out), span, whole, parts))
                    missing.update([p for p, c in zip(parts, codes) if c is None])
                else:
                    code = b"".join(codes)
                    if whole:
                        self.keep(span, code)
            out.append(code)
        if missing:
            if len(self.words) > MAX_WORDS:  # the words found above are given up as well
                missing = {p for _, _, _, parts in todo for p in parts}
            self.learn(missing)
            for at, span, whole, parts in todo:
                out[at] = b"".join(map(self.words.__getitem__, parts))
                if whole:
                    self.keep(span, out[at])
        return b"".join(out)

    def keep(self, chunk: bytes, code: bytes) -> None:
        if len(self.chunks) >= MAX_CHUNKS:
            self.chunks.clear()
        self.chunks[chunk] = code


def _edges(chunk: bytes) -> tuple[int, int]:
    """First and last ASCII white space, -1 where there is none."""
    found = [i for i in (chunk.find(c) for c in _SPACE) if i >= 0]
    return (min(found), max(chunk.rfind(c) for c in _SPACE)) if found else (-1, -1)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids as little-endian unsigned 32-bit integers (binary), and
    the text the library decodes them to (UTF-8 binary). ``path`` names the vocabulary file; by
    default each task asks the public package."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder = ChunkCoder(path or word_bpe_path())
        for batch in source:
            keys, ids, decoded, start, held = batch.column(0), [], [], 0, 0
            for text in batch.column(1):
                ids.append(coder.encode((text.as_py() or "").encode("utf-8", "replace")))
                decoded.append(coder.decode(ids[-1]))
                held += len(ids[-1]) + len(decoded[-1])
                if held > MAX_BATCH_BYTES or start + len(ids) == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([keys.slice(start, len(ids)), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"])
                    start, held, ids, decoded = start + len(ids), 0, [], []

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    coded = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(batches, f"doc_id {kind}, ids binary, decoded binary")
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


def digests(coded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``encode``'s rows."""
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
