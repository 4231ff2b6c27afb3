"""Exact encoding and decoding with a merge-type sentencepiece vocabulary.

A segmentation is what merging gives exactly when every two adjacent pieces are
what merging gives for their joined text. So a text is covered by longest matches
from an Aho-Corasick automaton; each new piece is checked against the one before
it by merging the two again, shorter pieces are tried on a clash, and a bit field
remembers positions from which no valid end was found.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablewright.llm.caches import Recent, kept

SPACE = "▁"
FIELDS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


class PieceCodec:
    """Encoder and decoder for the vocabulary in a model file; only pieces and scores are taken from it.

    For merge-type models with byte fallback, a dummy prefix, no normalisation, and
    spaces at the beginning of pieces only. Runs of spaces may be pieces of equal
    score: they merge after everything else, from the left.
    """

    def __init__(self, path: str) -> None:
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
        names = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = [0] * 256
        for i in range(size):
            if model.is_byte(i):
                self.byte_ids[int(names[i][3:5], 16)] = i
        self.score = {names[i]: model.get_score(i) for i in range(size) if i not in special}
        self.ids = {names[i]: i for i in range(size) if i not in special}
        self.known = {c for p in self.ids for c in p}
        if any(c not in self.ids for c in self.known) or any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("this vocabulary has pieces that the method does not cover")
        self.surface = [b"" if i in special and not model.is_byte(i) else
                        bytes([int(names[i][3:5], 16)]) if model.is_byte(i) else names[i].replace(SPACE, " ").encode()
                        for i in range(size)]
        self.is_byte = [model.is_byte(i) for i in range(size)]
        self.runs = {len(p) for p in self.ids if set(p) == {SPACE}}
        inner = [p for p in self.ids if set(p) != {SPACE} or len(p) == 1]
        if len({self.score[p] for p in inner}) < len(inner) or any(p.startswith(SPACE * 2) for p in inner):
            raise ValueError("pieces of equal score must be runs of spaces")
        # Pieces that merging cannot reach never occur.
        reached = {self.ids[p]: p for p in inner if len(p) == 1 or self.merge(p) == [p]}
        self.automaton = ahocorasick.Automaton()
        for i, p in reached.items():
            self.automaton.add_word(p, (len(p) - 1, i))
        self.automaton.make_automaton()
        self.names, self.length = names, [len(p) for p in names]
        usable = {p: i for i, p in reached.items()}
        self.shorter = {i: next((usable[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in usable), -1) for i, p in reached.items()}
        self.fits = Recent(self._fits, 400_000)
        self.unknown = re.compile(f"[^{re.escape(''.join(sorted(self.known)))}]")
        # No piece crosses two characters that are not adjacent in any piece.
        self.adjacent = {p[i:i + 2] for p in inner for i in range(len(p) - 1)}
        self.parts = Recent(self.backtrack, 250_000)
        self.words = Recent(self._ids, 250_000)

    def _fits(self, pair: int) -> bool:
        a, b = self.names[pair >> 32], self.names[pair & 0xFFFFFFFF]
        return self.merge(a + b) == [a, b]

    def merge(self, text: str) -> list[str]:
        """Joins the adjacent pair of the best score, the leftmost of equals, until none is a piece."""
        parts, none, score = list(text), float("-inf"), self.score.get
        scores = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) != none:
            i = scores.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = score(parts[i - 1] + parts[i], none)
            if i < len(scores):
                scores[i] = score(parts[i] + parts[i + 1], none)
        return parts

    def backtrack(self, text: str) -> list[int]:
        """Ids of a text of known characters with one space at most, at its beginning."""
        longest = [-1] * (len(text) + 1)
        for end, (less, piece) in self.automaton.iter(text):
            longest[end - less] = piece  # ends only grow, so the last match from a start is the longest
        length, shorter, fits = self.length, self.shorter, self.fits
        chosen: list[int] = []
        at, failed, piece, last = 0, 0, longest[0], -1
        while piece >= 0:
            end = at + length[piece]
            if not failed >> end & 1 and (last < 0 or fits[last << 32 | piece]):
                chosen.append(piece)
                at, last, piece = end, piece, longest[end]
            elif (piece := shorter[piece]) < 0:
                # Nothing fits from here: note it, and go on with a shorter form of the piece before.
                failed |= 1 << at
                piece = chosen.pop()
                at -= length[piece]
                last = chosen[-1] if chosen else -1
        return chosen

    def _known(self, text: str) -> list[int]:
        cuts = [i for i in range(1, len(text)) if text[i - 1:i + 1] not in self.adjacent]
        if not cuts:
            return self.parts[text]
        return [i for a, b in zip([0, *cuts], [*cuts, len(text)]) for i in self.parts[text[a:b]]]

    def _stretch(self, text: str) -> list[int]:
        """Ids of a text with one space at most, at its beginning; unknown characters become bytes."""
        if self.known.issuperset(text):
            return self._known(text)
        out: list[int] = []
        at = 0
        for found in self.unknown.finditer(text):
            out += self._known(text[at:found.start()]) if found.start() > at else []
            out += [self.byte_ids[b] for b in found.group().encode("utf-8", "replace")]
            at = found.end()
        return out + (self._known(text[at:]) if at < len(text) else [])

    def _ids(self, word: str) -> bytes:
        return np.array(self._stretch(word if word.startswith("\n") else SPACE + word), "<u4").tobytes()

    def _run(self, n: int) -> list[int]:
        """Ids of ``n`` spaces: the leftmost pair that is a piece is joined first."""
        length, after = [1] * n, list(range(1, n)) + [-1]
        before, alive = list(range(-1, n - 1)), [True] * n
        heap = [(i, i + 1, 2) for i in range(n - 1)] if 2 in self.runs else []
        while heap:
            i, j, total = heapq.heappop(heap)
            if not (alive[i] and alive[j] and after[i] == j and length[i] + length[j] == total):
                continue
            length[i], alive[j], after[i] = total, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and length[a] + length[b] in self.runs:
                    heapq.heappush(heap, (a, b, length[a] + length[b]))
        return [self.ids[SPACE * k] for k, good in zip(length, alive) if good]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, without begin or end ids."""
        if not text:
            return np.zeros(0, "<u4")
        if SPACE not in text:
            words = text.replace("\n", " \n").split(" ")
            if "" not in words and "\n" not in self.known:
                return np.frombuffer(b"".join(map(self.words.__getitem__, words)), "<u4")
        out: list[int] = []
        for spaces, word in re.findall(f"({SPACE}*)([^{SPACE}]*)", (SPACE + text).replace(" ", SPACE)):
            n = len(spaces)
            if n == 0:
                out += self._stretch(word)
            elif not word:
                out += self._run(n)
            else:
                head = self._stretch(SPACE + word)
                if n > 1 and head[0] == self.ids[SPACE]:
                    out += self._run(n) + head[1:]
                else:
                    out += (self._run(n - 1) if n > 1 else []) + head
        return np.array(out, "<u4")

    def decode_bytes(self, ids: Sequence[int]) -> bytes:
        """The text of ids in UTF-8. Bytes that are no valid text become U+FFFD each."""
        raw = b"".join(map(self.surface.__getitem__, ids))
        try:
            raw.decode()
        except UnicodeDecodeError:
            raw = self._repaired(ids)
        if len(ids) and raw.startswith(b" ") and not self.is_byte[ids[0]]:
            raw = raw[1:]
        return raw

    def _repaired(self, ids: Sequence[int]) -> bytes:
        out, held = [], b""
        for i in [*ids, None]:
            if i is not None and self.is_byte[i]:
                held += self.surface[i]
                continue
            while held:
                size = next((k for k in range(1, 5) if _is_text(held[:k])), 0)
                out.append(held[:size] if size else "�".encode())
                held = held[size or 1:]
            if i is not None:
                out.append(self.surface[i])
        return b"".join(out)


def _is_text(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


def encode_texts(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256, and the ids if asked for.

    Null texts count as empty. Null ids and repeated rows are kept as they are; other
    columns are not read; an empty table gives an empty result.
    """
    source = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept(f"pieces_{path}", lambda: PieceCodec(path))
        decimal = kept(f"decimal_{path}", lambda: [str(i) for i in range(len(codec.surface))])
        for batch in batches:
            counts, hashes, decoded, kept_ids = [], [], [], []
            for text in batch.column(1):
                found = codec.encode(text.as_py() or "").tolist()
                counts.append(len(found))
                hashes.append(hashlib.sha256(",".join(map(decimal.__getitem__, found)).encode()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode_bytes(found)).hexdigest())
                if ids:
                    kept_ids.append(found)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns, names = [*columns, pa.array(kept_ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, {FIELDS}" + ", ids array<int>" * ids)
