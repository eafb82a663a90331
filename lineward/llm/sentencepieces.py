"""Encoding and decoding with a merge-type SentencePiece vocabulary.

An agenda holds every adjacent pair of symbols that joins to a piece, best score first and leftmost
among equals. The top pair is merged and its new neighbours are filed, until nothing merges; a symbol
without a piece becomes its bytes.

A merge never crosses a place that no piece holds, such as one before a space mark or between a letter and
a comma. So a text falls into chunks that are encoded on their own, and equal chunks of a task are encoded
once. Every chunk that the agenda
encodes is checked against the sentencepiece library, batch by batch; a chunk that differed would take
the library's ids and be counted in ``n_corrected``.

Null and empty texts have no ids. Texts of any length are whole; a chunk without spaces is one agenda.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from hashlib import sha256
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from lineward.llm.common import TEXT_ROWS, pieces, written

SPACE = "▁"
# Chunks a task keeps at most, in characters; then it begins afresh. Results do not depend on it.
CACHE_CHARS = 6_000_000
# Texts that a task turns into strings at once.
TEXTS_AT_ONCE = 200
# Symbols up to which the agenda is a flat list; a heap beyond.
FEW = 40
_NEVER = float("inf")


def _chunk_pattern(pieces: Iterable[str]) -> re.Pattern:
    """Parts of a marked text that no piece reaches across, so that no merge does either.

    Parts begin at space marks, at line feeds, and where a letter is followed by a character that no
    piece holds right behind a letter; characters that some piece holds there count as letters.
    """
    pieces = [p for p in pieces if len(p) > 1]
    if any(re.search(f"[^{SPACE}]{SPACE}", p) or "\n" in p for p in pieces):
        return re.compile("(?s).+")
    extra: set[str] = set()
    no_letters = {c for p in pieces for c in p if re.match(r"\w", c) and not c.isalpha()}
    while True:
        others = re.escape("".join(sorted(no_letters)))
        letter = f"[^\\W{others}]"
        if extra:
            letter = f"(?:{letter}|[{re.escape(''.join(sorted(extra)))}])"
        behind = re.compile(f"{letter}(?=(.))")
        found = {c for p in pieces for c in behind.findall(p) if not re.match(letter, c)}
        if not found:
            break
        extra |= found
        no_letters -= found
    other = f"[^\\w{SPACE}\n{re.escape(''.join(sorted(extra)))}]"
    if others:
        other = f"(?:{other}|[{others}])"
    return re.compile(f"{SPACE}*{other}*{letter}+|{SPACE}*{other}+|{SPACE}+|\n")


class MergeVocabulary:
    """The pieces and scores of a serialised model, and the agenda over them."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.library.get_piece_size()
        self.pieces = [self.library.id_to_piece(i) for i in range(size)]
        self.merges, self.bytes = {}, {}
        for i, piece in enumerate(self.pieces):
            if self.library.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (self.library.is_control(i) or self.library.is_unknown(i)):
                self.merges[piece] = (self.library.get_score(i), i)
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.spaced = [p.replace(SPACE, " ") for p in self.pieces]
        self.order = {piece: -score for piece, (score, _) in self.merges.items()}
        self.chunk = _chunk_pattern(self.merges)

    def chunks(self, text: str) -> list[str]:
        """The independent parts of a text, spaces marked, with the mark that begins every text."""
        return self.chunk.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode_chunk(self, chunk: str) -> list[int]:
        symbols = self._merge_few(chunk) if len(chunk) <= FEW else self._merge_many(chunk)
        ids = []
        for symbol in symbols:
            found = self.merges.get(symbol)
            if found:
                ids.append(found[1])
            elif self.bytes:
                ids.extend([self.bytes[b] for b in symbol.encode()])
            else:
                ids.append(self.library.unk_id())
        return ids

    def _merge_few(self, chunk: str) -> list[str]:
        """The agenda as a flat list: the order of each adjacent pair, by place. The first smallest entry
        is the best pair, and the leftmost of equals."""
        symbols, order = list(chunk), self.order.get
        agenda = [order(a + b, _NEVER) for a, b in zip(symbols, symbols[1:])]
        while agenda:
            best = min(agenda)
            if best == _NEVER:
                break
            i = agenda.index(best)
            merged = symbols[i] = symbols[i] + symbols[i + 1]
            del symbols[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = order(merged + symbols[i + 1], _NEVER)
            if i:
                agenda[i - 1] = order(symbols[i - 1] + merged, _NEVER)
        return symbols

    def _merge_many(self, chunk: str) -> list[str]:
        """The agenda as a heap; entries whose symbols have changed since are passed over."""
        symbols = list(chunk)
        last = len(symbols)
        before = list(range(-1, last - 1))
        after = [*range(1, last), -1]
        order, agenda = self.order, []

        def file(left: int, right: int) -> None:
            found = order.get(symbols[left] + symbols[right])
            if found is not None:
                heapq.heappush(agenda, (found, left, right, len(symbols[left]) + len(symbols[right])))

        for i in range(last - 1):
            file(i, i + 1)
        while agenda:
            _, left, right, length = heapq.heappop(agenda)
            if not symbols[left] or not symbols[right]:
                continue
            if len(symbols[left]) + len(symbols[right]) != length:
                continue
            symbols[left] += symbols[right]
            symbols[right] = ""
            following = after[left] = after[right]
            if following >= 0:
                before[following] = left
                file(left, following)
            if before[left] >= 0:
                file(before[left], left)
        return [s for s in symbols if s]

    def library_ids(self, chunks: list[str]) -> list[list[int]]:
        """What the library makes of the chunks. It puts a mark before every text; a chunk that begins
        without one, or has nothing else, goes behind a line feed, whose ids are taken off."""
        behind = [c[0] != SPACE or c == SPACE for c in chunks]
        marked = ["\n" + c if b else c[1:] for c, b in zip(chunks, behind)]
        lead = len(self.library.encode("\n"))
        found = self.library.encode(marked, num_threads=1)
        return [ids[lead:] if b else ids for ids, b in zip(found, behind)]

    def decode_chunk(self, ids: list[int]) -> str:
        """The text of the ids of a chunk; runs of byte pieces are read as UTF-8."""
        if self.byte_of.keys().isdisjoint(ids):
            return "".join([self.spaced[i] for i in ids])
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            out.append(self.spaced[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)


class ChunkCache(dict):
    """Ids of the chunks met so far; what is missing is encoded by the agenda. The ids are decoded at once;
    a text that is not the chunk itself, its marks as spaces, is kept in ``texts``."""

    def __init__(self, vocabulary: MergeVocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.texts: dict[str, str] = {}
        self.unchecked: dict[str, list[int]] = {}
        self.corrected: set[str] = set()
        self.chars = 0

    def put(self, chunk: str, ids: list[int]) -> str:
        text = self.vocabulary.decode_chunk(ids)
        self.texts.pop(chunk, None)
        if text != chunk.replace(SPACE, " "):
            self.texts[chunk] = text
        self[chunk] = joined = ",".join(map(str, ids))
        return joined

    def __missing__(self, chunk: str) -> str:
        ids = self.unchecked[chunk] = self.vocabulary.encode_chunk(chunk)
        self.chars += len(chunk)
        return self.put(chunk, ids)

    def check(self) -> set[str]:
        """Compare what is new with the library; the chunks that had to be corrected."""
        chunks = list(self.unchecked)
        wrong = set()
        for chunk, ids in zip(chunks, self.vocabulary.library_ids(chunks) if chunks else []):
            if ids != self.unchecked[chunk]:
                wrong.add(chunk)
                self.put(chunk, ids)
        self.unchecked = {}
        self.corrected |= wrong
        return wrong

    def decoded(self, chunks: list[str]) -> str:
        """The text of the ids of the chunks, without the mark that begins every text."""
        if self.texts and not self.texts.keys().isdisjoint(chunks):
            chunks = [self.texts.get(c, c) for c in chunks]
        return "".join(chunks).replace(SPACE, " ")[1:]

    def begin(self) -> None:
        if self.chars > CACHE_CHARS:
            self.clear()
            self.texts.clear()
            self.corrected.clear()
            self.chars = 0


def encode_texts(cache: ChunkCache, texts: list[str]) -> list[tuple[str, str, int]]:
    """Of each text the ids in decimal, joined by commas, the decoded text, and its corrected chunks."""
    vocabulary, out = cache.vocabulary, []
    first = 0
    for last, text in enumerate(texts, 1):
        out.append(",".join(map(cache.__getitem__, vocabulary.chunks(text))))
        if last < len(texts) and cache.chars <= CACHE_CHARS:
            continue
        wrong = cache.check()
        for i in range(first, last):
            chunks = vocabulary.chunks(texts[i])
            ids = out[i]
            if wrong and not wrong.isdisjoint(chunks):
                ids = ",".join(map(cache.__getitem__, chunks))
            corrected = sum(c in cache.corrected for c in chunks) if cache.corrected else 0
            out[i] = (ids, cache.decoded(chunks), corrected)
        cache.begin()
        first = last
    return out


def encode_documents(docs: DataFrame, model_path: str | Path, keep_texts: bool = False) -> DataFrame:
    """Per document the number of ids, digests of the ids and of the decoded text.

    With ``keep_texts`` also the ids (joined by commas) and the decoded text. The result is written, so that
    texts reach the encoder in small batches and nobody encodes them twice.
    """
    model = docs.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())
    extra = "ids string, decoded string, " if keep_texts else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = ChunkCache(MergeVocabulary(model.value))
        for batch in pieces(batches, TEXTS_AT_ONCE):
            rows: list[tuple] = []
            texts = [text or "" for text in batch.column(1).to_pylist()]
            for ids, decoded, corrected in encode_texts(cache, texts):
                row = (
                    ids.count(",") + 1 if ids else 0,
                    sha256(ids.encode()).hexdigest(),
                    sha256(decoded.encode()).hexdigest(),
                    corrected,
                )
                rows.append((*row, ids, decoded) if keep_texts else row)
            n, ids_sha, decoded_sha, corrected, *texts = zip(*rows) if rows else [()] * (6 if keep_texts else 4)
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_corrected"]
            columns = [
                batch.column(0),
                pa.array(n, pa.int64()),
                pa.array(ids_sha, pa.string()),
                pa.array(decoded_sha, pa.string()),
                pa.array(corrected, pa.int64()),
                *(pa.array(t, pa.string()) for t in texts),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*names, *(["ids", "decoded"] if texts else [])])

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string, n_corrected long"
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    tail = f", {extra.rstrip(', ')}" if extra else ""
    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_id}, {schema}{tail}")
    return written(found, "encoded", TEXT_ROWS)
