"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies by a score-ordered agenda.

A normalised text is cut before every run of the blank mark U+2581: no piece of the vocabulary holds that mark after
another character (checked when the model is loaded), so no merge crosses such a cut and each chunk can be encoded alone. A
chunk starts as single characters; adjacent pairs that form a piece wait in an agenda ordered by score, highest first,
then by place, leftmost first. The best pair whose two symbols are still there is merged and its new neighbours join
the agenda. What remains are the pieces; characters outside the vocabulary become byte pieces. Decoding goes back from
ids to text, chunk by chunk.

The agendas of all new chunks of an Arrow batch advance together, one merge a step, as rows of a matrix whose row maximum is the
head of the agenda (long chunks, and models with equal scores, take a heap each). The new chunks are encoded by the sentencepiece
library as well; where the two differ the library's ids count and `n_corrected` says how often a text was concerned (never, as far as
known). Ids of chunks are kept per worker in a bounded table of two generations: a full one becomes the old one, from which chunks
still in use move on. A chunk of plain pieces decodes to itself; only others are decoded.

Defined results: null and empty texts give the end id only and decode to an empty text; texts of any length are encoded whole;
repeated rows are encoded one by one; of equal scores the leftmost pair is first; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import slices, table

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
KEPT = 125_000  # chunks of a generation
ROW = 48  # symbols of a chunk up to which it is a matrix row
NONE = np.iinfo(np.int32).max
DEFAULT_MODEL = "piece_bpe_32k.model"


def model_path(name: str = DEFAULT_MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Codec:
    """Pieces, scores and byte ids of one model, and the chunks already encoded."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        rule = spec.normalizer_spec
        if spec.trainer_spec.model_type != 2 or rule.precompiled_charsmap or rule.remove_extra_whitespaces or not rule.add_dummy_prefix:
            raise ValueError("a merge-type model with identity normalisation and a dummy prefix is asked for")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text = [p.piece for p in spec.pieces]
        self.id = {p.piece: k for k, p in enumerate(spec.pieces) if p.type == 1}
        self.score = {p.piece: p.score for p in spec.pieces if p.type == 1}
        self.byte = {int(p.piece[3:5], 16): k for k, p in enumerate(spec.pieces) if p.type == 6}
        self.plain = set(self.id.values())
        self.value = {k: v for v, k in self.byte.items()}
        self.end, self.unknown = self.library.eos_id(), self.library.unk_id()
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id) or len(self.byte) != 256:
            raise ValueError("pieces must hold the blank mark at their start only, and all bytes")
        self.known: dict[str, str] = {}  # ids of a chunk as text
        self.older: dict[str, str] = {}
        self.odd: dict[str, str] = {}  # decoded chunks that differ from the chunk
        self.corrected: set[str] = set()
        self.number = [str(k) for k in range(len(self.text))]
        self._pair_table()

    def _pair_table(self) -> None:
        """Sorted codes (left id * width + right id) of the pairs that form a piece, with the piece's place by score."""
        self.width = len(self.text)
        self.symbol = {p: k for p, k in self.id.items() if len(p) == 1}
        pairs = {}
        for piece, k in self.id.items():
            for cut in range(1, len(piece)):
                a, b = self.id.get(piece[:cut]), self.id.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = k
        code = np.array(sorted(pairs), np.int64)
        order = sorted(self.id.values(), key=lambda k: -self.score[self.text[k]])
        self.by_place = np.array([*order, -1], np.int32)
        place = np.full(self.width, NONE, np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.pair_code, self.pair_place = code, np.array([place[pairs[c]] for c in code.tolist()], np.int32)
        shared = Counter(self.score[self.text[k]] for k in set(pairs.values()))
        tied = sorted({self.text[k] for k in pairs.values() if shared[self.score[self.text[k]]] > 1}, key=len)
        self.tied = re.compile("|".join(map(re.escape, tied))) if tied else None  # pieces of equal score have no places of their own

    def places(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place by score of the piece each pair forms, NONE where it forms none; ids from `width` on are unknown characters or ends."""
        code = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.pair_code, code), len(self.pair_code) - 1)
        return np.where((self.pair_code[at] == code) & (right < self.width), self.pair_place[at], NONE)

    def row_agendas(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk (with its mark), unknown characters as width + code point; the chunks are of like length."""
        length = np.array([len(c) for c in chunks])
        flat = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
        points, at = np.unique(flat, return_inverse=True)
        ids = np.array([self.symbol.get(chr(p), self.width + p) for p in points.tolist()], np.int64)[at]
        wide = int(length.max())
        inside = np.arange(wide) < length[:, None]
        symbols = np.full((len(chunks), wide), 2 * self.width + 0x110000, np.int64)
        symbols[inside] = ids
        waiting = np.full((len(chunks), wide), NONE, np.int32)
        waiting[:, :-1] = self.places(symbols[:, :-1], symbols[:, 1:])
        out: list = [None] * len(chunks)
        rows, columns = np.arange(len(chunks)), np.arange(wide)
        while len(rows):
            k = waiting.argmin(1)  # the leftmost of the best
            best = waiting[np.arange(len(rows)), k]
            done = best == NONE
            if done.any():
                for i, found, n in zip(rows[done].tolist(), symbols[done].tolist(), length[done].tolist(), strict=True):
                    out[i] = found[:n]
                rows, symbols, waiting, length, k, best = (x[~done] for x in (rows, symbols, waiting, length, k, best))
                if not len(rows):
                    break
            each = np.arange(len(rows))
            length = length - 1
            moved = np.minimum(columns + (columns > k[:, None]), wide - 1)
            symbols = np.take_along_axis(symbols, moved, 1)
            waiting = np.take_along_axis(waiting, moved, 1)
            symbols[each, k] = self.by_place[best]
            symbols[:, -1], waiting[:, -1] = 2 * self.width + 0x110000, NONE
            before, after = np.maximum(k - 1, 0), np.minimum(k + 1, wide - 1)
            waiting[each, k] = np.where(after > k, self.places(symbols[each, k], symbols[each, after]), NONE)
            waiting[each, before] = np.where(k > 0, self.places(symbols[each, before], symbols[each, k]), waiting[each, before])
            wide = int(length.max())
            symbols, waiting, columns = symbols[:, :wide], waiting[:, :wide], columns[:wide]
        return out

    def _heap_agenda(self, chunk: str) -> list[str]:
        score, symbols = self.score, [*chunk]
        last = len(symbols) - 1
        before, after = [*range(-1, last)], [*range(1, last + 2)]
        waiting = []
        for k in range(last):
            both = symbols[k] + symbols[k + 1]
            if both in score:
                waiting.append((-score[both], k, both))
        heapq.heapify(waiting)
        while waiting:
            _, k, both = heapq.heappop(waiting)
            right = after[k]
            if not symbols[k] or right > last or symbols[k] + symbols[right] != both:
                continue  # one of the two has been merged into something else
            symbols[k], symbols[right] = both, ""
            after[k] = following = after[right]
            if following <= last:
                before[following] = k
                joined = both + symbols[following]
                if joined in score:
                    heapq.heappush(waiting, (-score[joined], k, joined))
            if (left := before[k]) >= 0:
                joined = symbols[left] + both
                if joined in score:
                    heapq.heappush(waiting, (-score[joined], left, joined))
        return [s for s in symbols if s]

    def ids(self, chunk: str) -> list[int]:
        """Ids of one chunk by its own heap."""
        pieces = self._heap_agenda(chunk)
        return [k for p in pieces for k in ([self.id[p]] if p in self.id else map(self.byte.get, p.encode()))]

    def all_ids(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk (given with its mark)."""
        out: list = [None] * len(chunks)
        groups: dict[int, list[int]] = {}
        for i, c in enumerate(chunks):
            if len(c) > ROW or self.tied and self.tied.search(c):
                out[i] = self.ids(c)
            else:
                groups.setdefault(len(c).bit_length(), []).append(i)
        for group in groups.values():
            for start in range(0, len(group), 20_000):
                part = group[start : start + 20_000]
                for i, got in zip(part, self.row_agendas([chunks[i] for i in part]), strict=True):
                    if max(got) >= self.width:
                        got = [k for g in got for k in ([g] if g < self.width else map(self.byte.get, chr(g - self.width).encode()))]
                    out[i] = got
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids: control ids vanish, byte runs become characters, marks become blanks, the dummy prefix goes."""
        if all(map(self.plain.__contains__, ids)):
            text = "".join([self.text[k] for k in ids]).replace(MARK, " ")
            return text[1:] if text.startswith(" ") else text
        out, raw = [], bytearray()
        for k in [*ids, -1]:
            if k in self.value:
                raw.append(self.value[k])
                continue
            if raw:
                out.append(raw.decode(errors="replace"))
                raw.clear()
            if k == self.unknown:
                out.append(" ⁇ ")
            elif k >= 0 and not self.library.is_control(k):
                out.append(self.text[k])
        text = "".join(out).replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text

    def chunks(self, text: str) -> list[str]:
        """Chunks without their first mark."""
        if not text:
            return []
        if "  " not in text and MARK not in text and text[0] != " ":
            return text.split(" ")
        return [c[1:] for c in CHUNK.findall(MARK + text.replace(" ", MARK))]

    def library_ids(self, chunks: list[str]) -> list[list[int]]:
        """What the library makes of each chunk (without its mark)."""
        theirs = self.library.encode([c.replace(MARK, " ") for c in chunks], num_threads=1)
        if "" in chunks:  # a text that ends with a blank, less the same text without it
            theirs[chunks.index("")] = self.library.encode("a ")[len(self.library.encode("a")) :]
        return theirs

    def learn(self, batch: list[list[str]]) -> None:
        """Encode the chunks not known yet and hold them against the library; afterwards `known` has all chunks of the batch."""
        if len(self.known) > KEPT:
            self.older, self.known = self.known, {}
            self.odd = {c: back for c, back in self.odd.items() if c in self.older}
            self.corrected &= self.older.keys()
        new = []
        for chunk in set().union(*batch).difference(self.known):
            if (said := self.older.get(chunk)) is not None:
                self.known[chunk] = said
            else:
                new.append(chunk)
        for chunk, got, want in zip(new, self.all_ids([MARK + c for c in new]), self.library_ids(new) if new else [], strict=True):
            if got != want:
                got = want
                self.corrected.add(chunk)
            self.known[chunk] = " ".join(map(self.number.__getitem__, got))
            if MARK in chunk or not self.plain.issuperset(got):
                back = self.decode(got)
                if back != chunk:
                    self.odd[chunk] = back

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.all_ids([MARK + c for c in self.chunks(text)]) for i in ids] + [self.end]


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def sentencepiece_codec(docs: DataFrame, path: str | None = None, with_text: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded, n_corrected) of every row of docs(doc_id, text); ids and decoded as digests unless with_text."""
    path = path or model_path()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.string()), ("decoded", pa.string()), ("n_corrected", pa.int64())])

    def run(batches):
        own = codec(path)
        show = (lambda s: s) if with_text else (lambda s: hashlib.sha256(s.encode()).hexdigest())
        for part in slices(batches):
            batch = [own.chunks(t or "") for t in part.column("text").to_pylist()]
            own.learn(batch)
            n, ids, texts, corrected = [], [], [], []
            for chunks in batch:
                said = " ".join([*map(own.known.__getitem__, chunks), str(own.end)])
                n.append(said.count(" ") + 1)
                ids.append(show(said))
                texts.append(show(" ".join([own.odd.get(c, c) for c in chunks] if own.odd else chunks)))
                corrected.append(sum(map(own.corrected.__contains__, chunks)) if own.corrected else 0)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(texts), pa.array(corrected, pa.int64())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids string, decoded string, n_corrected long")


def op5_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sentencepiece_codec(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"), "n_corrected")
