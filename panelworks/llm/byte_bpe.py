"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

Every prefix of a byte string has one valid encoding, and that ends in one token. The table stores this
token for each prefix: the token ``t`` that ends at a position such that ``t`` and the token stored at its
start survive the merges side by side. A whole encoding is read by walking back from the end.

- **Append:** an entry depends on earlier bytes only, so appending computes the new entries and no other.
- **Edit:** an entry depends on the bytes and entries of the last ``longest`` positions, the length of the
  longest token. After an edit, entries are recomputed from its place until that many in a row are equal
  to those stored before it; all later ones then stay.

Texts are split by the vocabulary's pattern first and each match is encoded by itself. A task takes the
distinct new matches of a batch in byte order and keeps one table for all of them: the common prefix with
the one before stays, the rest is appended. Codes of matches are kept in a bounded cache. A text's matches
are read in runs of bounded number, so a long text needs memory for its ids, not for its matches.

A match that is a token as a whole is taken as it stands, as the public library does. No rows are
shuffled: a text is encoded where it is read.

Defined results: a null text is the empty text, without tokens. Repeated rows are encoded alike, null ids
keep their row, other columns are ignored (only the id and the text are selected, so any names may
clash). An empty table gives no rows. Texts are encoded whole at any length.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PIECES = 400_000  # codes of matches kept per worker, and as many older ones; up to 170 MB
MAX_PAIRS = 500_000  # checked token pairs kept per worker; about 60 MB
RUN = 50_000  # matches looked at together, or characters of short texts
GROUP_CHARS = 2_000_000  # of texts encoded together


def ranks_path() -> str:
    """The public vocabulary's file on the machine that runs the task."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def split_pattern() -> str:
    """The public pattern that splits a text before the merges."""
    import public_tokenizers

    return public_tokenizers.PATTERN


class Vocabulary:
    """Token bytes and ranks, and which two tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        # Lengths of the tokens that end in the same three bytes, longest first; shorter tokens by fewer.
        short = {token: [2, 1] for token in ranks if len(token) == 2}
        ends: dict[bytes, set[int]] = {}
        for token in ranks:
            if len(token) > 2:
                ends.setdefault(token[-3:], set()).add(len(token))
        self.short = short
        self.lengths = {end: sorted(found, reverse=True) + short.get(end[1:], [1]) for end, found in ends.items()}
        self.pairs: dict[int, bool] = {}  # by left x number of tokens + right
        self.count = max(self.tokens, default=0) + 1
        self._reached: dict[int, bool] = {}
        self._edges: dict[int, tuple] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})

    def merged(self, data: bytes) -> list[int]:
        """Ids after merging, again and again, the first neighbours whose union has the least rank."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = self.ranks.get
        none = len(self.ranks)
        while len(parts) > 1:
            unions = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
            least = min(unions)
            if least == none:
                break
            at = unions.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def reached(self, token: int) -> bool:
        """Whether merging the token's bytes gives the token."""
        known = self._reached.get(token)
        if known is None:
            known = self._reached[token] = self.merged(self.tokens[token]) == [token]
        return known

    def edges(self, token: int) -> tuple[list[tuple[bytes, int]], list[tuple[bytes, int]]]:
        """The first and the last parts that merging the token's bytes goes through, each with the rank of
        the merge that ends it (beyond all ranks: none does)."""
        known = self._edges.get(token)
        if known is None:
            data, none = self.tokens[token], len(self.ranks)
            parts = [data[i : i + 1] for i in range(len(data))]
            first, last = [(parts[0], none)], [(parts[-1], none)]
            while len(parts) > 1:
                unions = [self.ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
                least = min(unions)
                at = unions.index(least)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                if at == 0:
                    first[-1] = (first[-1][0], least)
                    first.append((parts[0], none))
                if at == len(parts) - 1:
                    last[-1] = (last[-1][0], least)
                    last.append((parts[-1], none))
            known = self._edges[token] = first, last
        return known

    def fit(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives these two tokens.

        Each side is merged as if alone until a part across the border is merged: that happens when its rank
        comes before those of the merges that end the two parts at the border (of equal ranks, the leftmost
        merge comes first). Ranks of merges only rise, as a token's rank is above those of its parts.
        """
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        ends, starts = self.edges(left)[1], self.edges(right)[0]
        rank, none = self.ranks.get, len(self.ranks)
        i = j = 0
        fits = True
        while i < len(ends) and j < len(starts):
            (a, until), (b, before) = ends[i], starts[j]
            across = rank(a + b, none)
            if across < until and (across < before or across == before < none):
                fits = False
                break
            if until == before == none:
                break
            i, j = (i + 1, j) if until <= before else (i, j + 1)
        self.pairs[left * self.count + right] = fits
        return fits


class PrefixTable:
    """The last token of the encoding of each prefix of ``data``; ``last[p]`` belongs to p + 1 bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary = vocabulary
        self.data = b""
        self.last: list[int] = []
        self.append(data)

    def _tokens(self, start: int, last: list[int]) -> Iterator[int]:
        """The entries from ``start`` bytes on; the caller puts each into ``last`` before it asks for the next."""
        data, words = self.data, self.vocabulary
        rank, pairs, count = words.ranks.get, words.pairs, words.count
        lengths, short, single = words.lengths.get, words.short.get, [1]
        for size in range(start + 1, len(data) + 1):
            for length in (lengths(data[size - 3 : size]) if size > 2 else None) or short(data[max(size - 2, 0) : size], single):
                if length <= size and (token := rank(data[size - length : size])) is not None:
                    if length == size:
                        fits = words.reached(token)
                    else:
                        left = last[size - length - 1]
                        fits = pairs.get(left * count + token)
                        if fits is None:
                            fits = words.fit(left, token)
                    if fits:
                        yield token
                        break
            else:
                raise ValueError(f"no token of the vocabulary ends byte {size} of {data[:size]!r}")

    def append(self, more: bytes) -> None:
        """Entries of the prefixes that end in ``more``; all before stay."""
        start = len(self.data)
        self.data += more
        for token in self._tokens(start, self.last):
            self.last.append(token)

    def cut(self, size: int) -> None:
        """Keep the first ``size`` bytes."""
        self.data = self.data[:size]
        del self.last[size:]

    def edit(self, at: int, removed: int, added: bytes) -> int:
        """Put ``added`` in place of ``removed`` bytes at ``at``; the number of entries computed."""
        old, shift = self.last, removed - len(added)
        self.data = self.data[:at] + added + self.data[at + removed :]
        new = old[:at]
        alike = 0
        for size, token in enumerate(self._tokens(at, new), at + 1):
            new.append(token)
            # Entries after the added bytes, compared with those stored for the same bytes before.
            alike = alike + 1 if size > at + len(added) and new[-1] == old[size - 1 + shift] else 0
            if alike >= self.vocabulary.longest:
                self.last = new + old[size + shift :]
                return size - at
        self.last = new
        return len(self.data) - at

    def ids(self) -> list[int]:
        """Token ids of the whole."""
        out, last, sizes, size = [], self.last, self.vocabulary.sizes, len(self.data)
        while size:
            token = last[size - 1]
            out.append(token)
            size -= sizes[token]
        out.reverse()
        return out


class Coder:
    """Encodes texts match by match; a code is ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, vocabulary: Vocabulary, pattern: str) -> None:
        import regex

        self.pattern = regex.compile(pattern)
        self.vocabulary = vocabulary
        self.table = PrefixTable(vocabulary)
        self.names = np.array([vocabulary.tokens.get(i, b"") for i in range(max(vocabulary.tokens, default=-1) + 1)], dtype=object)
        self.codes: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # the cache before it was last full

    def piece(self, data: bytes) -> bytes:
        """Code of one match. The table keeps the prefix it shares with the match before."""
        table = self.table
        held, low, high = table.data, 0, min(len(table.data), len(data))
        while low < high and held[low : low + 4] == data[low : low + 4]:
            low += 4
        low = min(low, high)
        while low < high and held[low] == data[low]:
            low += 1
        table.cut(low)
        table.append(data[low:])
        return array("I", table.ids()).tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Codes of all of ``pieces``, from the cache or found in byte order."""
        if len(self.codes) + len(pieces) > MAX_PIECES:  # those in use lately stay
            self.before, self.codes = self.codes, {}
        todo = []
        for piece in pieces:
            code = self.before.get(piece)
            if code is None:
                todo.append((piece.encode("utf-8", "replace"), piece))
            else:
                self.codes[piece] = code
        todo.sort()
        whole = self.vocabulary.ranks.get
        for data, piece in todo:
            token = whole(data)
            self.codes[piece] = self.piece(data) if token is None else array("I", (token,)).tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Codes of whole texts; the new matches of all are found together."""
        found = list(map(self.pattern.findall, texts))
        new = set().union(*found)
        known = new & self.codes.keys()
        if len(known) < len(new):
            self.learn(new if len(self.codes) + len(new) - len(known) > MAX_PIECES else new - known)
        return [b"".join(map(self.codes.__getitem__, pieces)) for pieces in found]

    def encode(self, text: str) -> bytes:
        """Code of a whole text; a long one is read in runs of matches."""
        if len(text) <= RUN:
            return self.encode_all([text])[0]
        found, out = self.pattern.finditer(text), []
        while pieces := [m.group() for m in islice(found, RUN)]:
            self.learn({p for p in pieces if p not in self.codes} if len(self.codes) + RUN <= MAX_PIECES else set(pieces))
            out.append(b"".join(map(self.codes.__getitem__, pieces)))
        return b"".join(out)

    def decode(self, code: bytes) -> bytes:
        """The bytes the ids stand for."""
        return b"".join(self.names[np.frombuffer(code, dtype="<u4")].tolist())


@lru_cache(maxsize=1)
def worker_coder(path: str, pattern: str) -> Coder:
    """One coder for all tasks a Python worker runs."""
    return Coder(Vocabulary.load(path), pattern)


class EditableText:
    """A text whose ids follow appends and edits: only matches near the edit are found and encoded anew."""

    def __init__(self, coder: Coder, text: str = "") -> None:
        self.coder = coder
        self.text = text
        self.pieces: list[tuple[int, bytes]] = []  # end in the text, code
        self._scan(0, [])

    def _scan(self, start: int, old: list[tuple[int, bytes]], settled: int = 0) -> int:
        """Matches from ``start`` on, until one past ``settled`` ends where an old one does."""
        ends = {end: i for i, (end, _) in enumerate(old)}
        fresh = 0
        for match in self.coder.pattern.finditer(self.text, start):
            fresh += 1
            self.pieces.append((match.end(), self.coder.encode(match.group())))
            if match.end() > settled and match.end() in ends:
                self.pieces += old[ends[match.end()] + 1 :]
                break
        return fresh

    def append(self, more: str) -> int:
        return self.edit(len(self.text), 0, more)

    def edit(self, at: int, removed: int, added: str) -> int:
        """Replace ``removed`` characters at ``at``; the number of matches found anew."""
        shift = len(added) - removed
        kept = len(self.pieces)
        # A match reads one character beyond its end, and white space as far as the next word.
        while kept and self.pieces[kept - 1][0] >= at:
            kept -= 1
        kept = max(0, kept - 1)
        old = [(end + shift, code) for end, code in self.pieces[kept:] if end >= at + removed]
        self.text = self.text[:at] + added + self.text[at + removed :]
        self.pieces = self.pieces[:kept]
        return self._scan(self.pieces[-1][0] if kept else 0, old, at + len(added))

    def ids(self) -> list[int]:
        return np.frombuffer(b"".join(code for _, code in self.pieces), "<u4").tolist()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>, decoded binary): ids of each whole text and the bytes they decode to.
    ``path`` names the file of ranks and ``pattern`` the split; by default tasks ask the public package."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(Vocabulary.load(path or ranks_path()), pattern or split_pattern())
        def coded(texts: list[str]) -> list[bytes]:
            short = iter(coder.encode_all([t for t in texts if len(t) <= RUN]))
            return [next(short) if len(t) <= RUN else coder.encode(t) for t in texts]

        for batch in source:
            start, texts, held = 0, [], 0
            for n, text in enumerate(batch.column(1), 1):
                texts.append(text.as_py() or "")
                held += len(texts[-1])
                if held > GROUP_CHARS or n == batch.num_rows:
                    codes = coded(texts)
                    offsets = np.cumsum([0, *[len(c) // 4 for c in codes]]).astype(np.int32)
                    ids = pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(codes), dtype="<i4"))
                    decoded = pa.array([coder.decode(c) for c in codes], pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, n - start), ids, decoded], names=["doc_id", "ids", "decoded"])
                    start, texts, held = n, [], 0

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(batches, f"doc_id {kind}, ids array<int>, decoded binary")


def digests(coded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``encode``'s rows."""
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
