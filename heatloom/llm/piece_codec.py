"""Exact merge-type (BPE) SentencePiece encoding by backtracking, and decoding.

A tokenization equals the one by merges if every pair of adjacent tokens survives re-merging of its own text. So
encoding walks over the longest pieces that start at each position (Aho-Corasick over reversed pieces), falls back
to the next shorter prefix when a neighbour does not fit, and remembers failed positions in a bitfield.

Scores may tie only among pieces of nothing but spaces, where the pair rule does not hold; stretches with two spaces in a
row are therefore merged directly.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.llm.common import texts_of
from heatloom.llm.pretokens import Bounded, Recent

SPACE = "▁"


class PieceCodec:
    def __init__(self, path: str, cached: int = 600_000):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.begin, self.end = model.bos_id(), model.eos_id()
        control = {i for i in ids if model.is_control(i) or model.is_unknown(i)}
        self.byte_id = {int(model.id_to_piece(i)[1:-1], 16): i for i in ids if model.is_byte(i)}
        byte_of = {i: b for b, i in self.byte_id.items()}
        self.piece = {i: model.id_to_piece(i) for i in ids if i not in control and i not in byte_of}
        self.id = {p: i for i, p in self.piece.items()}
        self.score = {p: model.get_score(i) for p, i in self.id.items()}
        self.surface = {i: b"" for i in control}
        self.surface |= {i: bytes([b]) for i, b in byte_of.items()}
        self.surface |= {i: p.replace(SPACE, " ").encode() for i, p in self.piece.items()}
        self.surfaces = [self.surface[i] for i in ids]
        # Pieces that merging can reach, for the automaton; each one's longest proper prefix that is such a piece too.
        usable = {p for p in self.id if len(p) == 1 or (p.strip(SPACE) and self.merged(p) == [p])}
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in usable), None) for p in usable}
        self.starts = ahocorasick.Automaton()
        for p in usable:
            self.starts.add_word(p[::-1], p)
        self.starts.make_automaton()
        self.fits = Bounded(lambda pair: self.merged(pair[0] + pair[1]) == [*pair], most=500_000)
        known = set("".join(self.id))
        alone = "" if "\n" in known else r"\n|"
        gap = "" if "\n" in known else r"\n"
        self.stretches = re.compile(f"{alone}{SPACE}+[^{SPACE}{gap}]*|[^{SPACE}{gap}]+").findall
        self.packed = {p: np.uint32(i).astype("<u4").tobytes() for p, i in self.id.items()}
        self.coded = Recent(self.encode_stretch, most=cached)

    def merged(self, text: str) -> list[str]:
        """Pieces of the text after all merges: best score first, the leftmost of equal ones."""
        parts: list[str | None] = list(text)
        left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            both = parts[i] + parts[j]
            if both in self.score:
                heapq.heappush(heap, (-self.score[both], i, j, both))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or right[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            right[i] = right[j]
            if right[i] < len(parts):
                left[right[i]] = i
                offer(i, right[i])
            if left[i] >= 0:
                offer(left[i], i)
        return [p for p in parts if p is not None]

    def numbered(self, pieces: list[str]) -> bytes:
        """Ids, packed; a character that is no piece becomes its bytes."""
        return b"".join([self.packed[p] if p in self.packed else np.array([self.byte_id[b] for b in p.encode()], "<u4").tobytes() for p in pieces])

    def encode_stretch(self, text: str) -> bytes:
        """Packed ids of a stretch over whose ends no piece reaches."""
        if SPACE * 2 in text:
            return self.numbered(self.merged(text))
        n = len(text)
        # of the matches at a place the automaton gives the longest one first, and the last one put into a dict stays
        found = dict(reversed(list(self.starts.iter(text[::-1]))))
        longest = list(map(found.get, range(n - 1, -1, -1)))
        if len(found) == n:
            return self.stretch_of_pieces(text, longest)
        out: list[bytes] = []
        at = 0
        while at < n:
            if longest[at] is None:
                out.append(self.numbered([text[at]]))
                at += 1
                continue
            stop = at
            while stop < n and longest[stop] is not None:
                stop += 1
            out.append(self.stretch_of_pieces(text[at:stop], longest[at:stop]))
            at = stop
        return b"".join(out)

    def stretch_of_pieces(self, text: str, longest: list[str]) -> bytes:
        """Packed ids of a text at each of whose places a piece starts."""
        found = self.backtrack(longest)
        return self.numbered(self.merged(text)) if found is None else b"".join(map(self.packed.__getitem__, found))

    def backtrack(self, longest: list[str]) -> list[str] | None:
        """Pieces of a text whose longest piece from each place on is given, each pair of which stays when its text is merged again."""
        fits, shorter, n = self.fits, self.shorter, len(longest)
        taken: list[str] = []
        at, failed, token, last = 0, 0, longest[0], None
        while at < n:
            while token is not None:
                if (last is None or fits[last, token]) and not (failed and failed >> at + len(token) & 1):
                    break
                token = shorter[token]
            if token is not None:
                taken.append(token)
                at += len(token)
                last, token = token, longest[at] if at < n else None
            elif last is None:
                return None
            else:
                failed |= 1 << at
                taken.pop()
                at -= len(last)
                token, last = shorter[last], taken[-1] if taken else None
        return taken

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, with begin and end."""
        body = b""
        if text:
            body = b"".join(map(self.coded.__getitem__, self.stretches(SPACE + text.replace(" ", SPACE))))
        return np.uint32(self.begin).astype("<u4").tobytes() + body + np.uint32(self.end).astype("<u4").tobytes()

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the text; the space that encoding puts before the text goes."""
        out = b"".join(map(self.surfaces.__getitem__, ids))
        return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace").encode()


_WORKER: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    if path not in _WORKER:
        _WORKER[path] = PieceCodec(path)
    return _WORKER[path]


def encode_decode(docs: DataFrame, model: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs (doc_id, text); with_ids adds ids and decoded.

    A null text is the empty text: begin and end ids only. Rows with a null or repeated doc_id are encoded like
    others; other columns are ignored, so their names cannot clash; an empty table gives an empty one. Long texts are
    encoded whole; a stretch without spaces takes memory in proportion to its length and is not cached.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches):
        use = codec(model)
        for batch in batches:
            cols: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
            for text in texts_of(batch):
                raw = use.encode(text)
                ids = np.frombuffer(raw, "<u4").tolist()
                back = use.decode(ids)
                cols["n_tokens"].append(len(ids))
                cols["ids_sha256"].append(hashlib.sha256(raw).hexdigest())
                cols["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
                if with_ids:
                    cols["ids"].append(ids)
                    cols["decoded"].append(back.decode())
            arrays = [batch.column("doc_id"), pa.array(cols["n_tokens"], pa.int64()), pa.array(cols["ids_sha256"], pa.string()), pa.array(cols["decoded_sha256"], pa.string())]
            if with_ids:
                arrays += [pa.array(cols["ids"], pa.list_(pa.int32())), pa.array(cols["decoded"], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)
