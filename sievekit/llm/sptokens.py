"""SentencePiece encoding and decoding, with sampled segmentations.

A text's segmentations into pieces of a vocabulary form a lattice. Forward filtering sums,
for every place, the weights of all ways to reach it; backward sampling starts at the end
and picks the last piece in proportion to the weights, then the one before, and so on, which
draws a whole segmentation from their exact distribution. The random numbers are hashes of
the row's key and the place in the text, so a row's sample doesn't depend on partitions,
batches or the run. Decoding joins the pieces and gives back the text, byte by byte.

A blank is the vocabulary's U+2581. Characters without a piece of their own fall back to
byte pieces, a U+2581 of the text as well, so no text is changed. No text is normalised and
no blank is put in front.

No piece crosses a place between two bytes that are never neighbours inside any piece (such
as before a blank). Texts are cut there into chunks, whose lattices are independent; the
chunks of a slice are filtered once each, however often they occur, and sampled together
with numpy.

The vocabulary is read from a model file on the driver (its path is a parameter), and its
pieces, a few hundred kilobytes, go to the tasks. A merge vocabulary has ranks and no
probabilities: a piece weighs (rank + SHIFT) ^ -ALPHA.

Edge cases: null text has null ids; an empty text has none; long texts are handled whole
(memory follows the longest one); rows with equal key and text get equal ids, null is a key
like any other; other columns are carried along, and ``ids`` is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.llm.common import mix64, sliced, text_buffer

ALPHA, SHIFT = 1.0, 10.0
SEED = 6
SLICE_BYTES = 3 << 20
BLANK = "▁"
_u = np.uint64


def default_model() -> str:
    """The public 32,000-piece vocabulary, where it is installed."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


@dataclass(frozen=True)
class Vocabulary:
    """Pieces as bytes with a plain blank, their log weights, and the ids of byte pieces."""

    pieces: tuple[bytes, ...]
    log_weight: tuple[float, ...]  # -inf for pieces that no text may use
    byte_id: tuple[int, ...]

    @staticmethod
    def from_model(path: str | None = None, alpha: float = ALPHA) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or default_model())
        pieces, weights, byte_id = [], [], [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_id[int(piece[3:5], 16)] = i
                pieces.append(bytes([int(piece[3:5], 16)]))
            else:
                pieces.append(piece.replace(BLANK, " ").encode())
            plain = not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
            # User-defined pieces have no rank; they count as if in the middle.
            rank = -model.get_score(i) if model.get_score(i) > -1e8 else model.get_piece_size() / 2
            weights.append(-alpha * float(np.log(rank + SHIFT)) if plain else -np.inf)
        return Vocabulary(tuple(pieces), tuple(weights), tuple(byte_id))


class Lattice:
    """A vocabulary as a trie over bytes, and the sampler."""

    _made: dict[int, tuple[Vocabulary, Lattice]] = {}

    @classmethod
    def of(cls, vocabulary: Vocabulary) -> Lattice:
        """Made once in each Python worker."""
        key = id(vocabulary)
        if key not in cls._made or cls._made[key][0] is not vocabulary:
            cls._made.clear()
            cls._made[key] = (vocabulary, cls(vocabulary))
        return cls._made[key][1]

    def __init__(self, vocabulary: Vocabulary):
        children: list[dict[int, int]] = [{}]
        piece_at = [-1]
        self.joined = np.zeros(65536, bool)  # by two bytes: neighbours inside some piece
        for i, (piece, weight) in enumerate(zip(vocabulary.pieces, vocabulary.log_weight, strict=True)):
            if weight == -np.inf or not piece:
                continue
            node = 0
            for byte in piece:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    piece_at.append(-1)
                node = children[node][byte]
            if piece_at[node] < 0 or weight > vocabulary.log_weight[piece_at[node]]:
                piece_at[node] = i
            flat = np.frombuffer(piece, np.uint8).astype(np.int64)
            self.joined[flat[:-1] * 256 + flat[1:]] = True
        # Rows of the step table only for nodes with children; step[row, byte] is a node or 0.
        self.row = np.full(len(children), -1, np.int32)
        inner = [k for k, c in enumerate(children) if c]
        self.row[inner] = np.arange(len(inner))
        self.step = np.zeros((len(inner), 256), np.int32)
        for k in inner:
            self.step[self.row[k], list(children[k])] = list(children[k].values())
        self.step = self.step.ravel()
        self.piece_at = np.array(piece_at, np.int32)
        self.log_weight = np.array(vocabulary.log_weight)
        self.byte_id = np.array(vocabulary.byte_id, np.int32)
        if max(map(len, vocabulary.pieces)) >= 64:
            raise ValueError("pieces of 64 bytes or more are not supported")
        self.byte_weight = float(np.min(self.log_weight[np.isfinite(self.log_weight)]))

    def _arcs(self, data: np.ndarray, chunk_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece, log weight) of all pieces in chunks; chunk_end is given by byte."""
        heads = np.flatnonzero((data & 0xC0) != 0x80).astype(np.int32)
        width = np.diff(heads, append=len(data))  # bytes of the character, within the slice
        starts, ends, pieces = [], [], []
        own = np.zeros(len(heads), bool)  # the character has a piece of its own
        room = chunk_end[heads] - heads  # bytes from the character to the end of its chunk
        which, row, k = np.arange(len(heads), dtype=np.int32), np.zeros(len(heads), np.int32), 0
        while len(which):
            inside = room[which] > k
            which, row = which[inside], row[inside]
            node = self.step[(row << 8) + data[heads[which] + k]]
            live = node > 0
            which, node = which[live], node[live]
            piece = self.piece_at[node]
            found = piece >= 0
            hit = which[found]
            starts.append(heads[hit])
            ends.append(heads[hit] + (k + 1))
            pieces.append(piece[found])
            own[hit[width[hit] == k + 1]] = True
            row = self.row[node]
            on = row >= 0
            which, row, k = which[on], row[on], k + 1
        lone = (np.flatnonzero(np.repeat(~own, width)) + (heads[0] if len(heads) else 0)).astype(np.int32)
        starts.append(lone)
        ends.append(lone + 1)
        pieces.append(self.byte_id[data[lone]])
        weights = [self.log_weight[p] for p in pieces[:-1]] + [np.full(len(lone), self.byte_weight)]
        return np.concatenate(starts), np.concatenate(ends), np.concatenate(pieces), np.concatenate(weights)

    def _filter(self, data: np.ndarray, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward filtering of chunks that lie one after the other; ``chunk`` holds their bounds.

        Returns (run, start, piece, first): the arcs that end at byte place e lie together from
        ``first[e]`` on, and ``run`` sums their probabilities up to 1.
        """
        sizes = np.diff(chunk)
        start, end, piece, weight = self._arcs(data, np.repeat(chunk[1:], sizes))
        head = np.repeat(chunk[:-1], sizes)  # of the chunk, by byte
        depth = end - head[end - 1]
        # Pieces are shorter than 64 bytes. The order of a place's arcs is part of the sample.
        order = np.argsort((depth * np.int64(len(data) + 1) + end << 6) + (end - start))
        start, end, piece, weight, depth = (x[order] for x in (start, end, piece, weight, depth))
        # total[p] sums, as a logarithm, all ways from the chunk's first byte to place p; the last entry
        # stands for the first byte itself.
        total = np.zeros(len(data) + 2)
        before = np.where(start == head[end - 1], len(data) + 1, start)
        run = np.empty(len(start))
        first = np.zeros(len(data) + 1, np.int64)
        bounds = np.searchsorted(depth, np.arange(1, (depth[-1] if len(depth) else 0) + 2))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if lo == hi:
                continue
            way = weight[lo:hi] + total[before[lo:hi]]
            place = end[lo:hi]
            group = np.flatnonzero(np.diff(place, prepend=-1))
            count = np.diff(group, append=hi - lo)
            most = np.maximum.reduceat(way, group)
            part = np.exp(way - np.repeat(most, count))
            whole = np.add.reduceat(part, group)
            total[place[group]] = most + np.log(whole)
            first[place[group]] = lo + group
            run[lo:hi] = part / np.repeat(whole, count)
        # Sums within each group, one by one, so that they don't depend on what lies beside it.
        group = np.flatnonzero(np.diff(end, prepend=-1))
        count, at = np.diff(group, append=len(end)), group
        while len(at := at[count > 1] + 1):
            count = count[count > 1] - 1
            run[at] += run[at - 1]
        last = np.append(group[1:], len(end)) - 1 if len(group) else group
        run[last] = 1.0
        return run, start, piece, first

    def sample(self, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of every text; ``keys`` seeds each text."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        cut = np.zeros(len(data), bool)
        pair = data[:-1].astype(np.uint16) << 8 | data[1:]
        cut[1:] = ~self.joined[pair] & ((data[1:] & 0xC0) != 0x80)
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        begin = np.flatnonzero(cut)
        size = np.diff(begin, append=len(data))
        unique, which = _distinct(data, begin, size)
        # The distinct chunks, one after the other.
        length = size[unique]
        bounds = np.concatenate([[0], np.cumsum(length)])
        gather = np.repeat(begin[unique] - bounds[:-1], length) + np.arange(bounds[-1])
        run, start, piece, first = self._filter(data[gather], bounds)
        # Backward sampling of all chunks at once; ``end`` is a place among the distinct chunks.
        out = np.full(len(data), -1, np.int32)
        row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
        bounds = bounds.astype(np.int32)
        low, end = bounds[:-1][which], bounds[1:][which]
        shift = begin.astype(np.int32) - low  # from there to the place in the slice
        seed = mix64(keys.astype(_u))
        while len(end):
            place = end + shift
            mine = row[place - 1]
            h = mix64(seed[mine] + (place - offsets[mine]).astype(_u) * _u(0x9E3779B97F4A7C15))
            unit = (h >> _u(11)).astype(np.float64) / float(1 << 53)
            arc = first[end]
            on = np.flatnonzero(unit >= run[arc])
            while len(on):
                arc[on] += 1
                on = on[unit[on] >= run[arc[on]]]
            out[place - 1] = piece[arc]
            end = start[arc]
            on = end > low
            low, end, shift = low[on], end[on], shift[on]
        kept = out >= 0
        count = np.concatenate([[0], np.cumsum(kept)])
        return out[kept], count[offsets]


_kept_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(attempt: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, kept between slices."""
    have = _kept_powers.get(attempt)
    if have is None or len(have[0]) < n:
        base = int(mix64(np.array([attempt + 1], _u))[0]) | 1
        have = tuple(np.full(max(n, SLICE_BYTES), _u(b)) for b in (base, pow(base, -1, 1 << 64)))
        for powers in have:
            powers[0] = 1
            np.multiply.accumulate(powers, out=powers)
        _kept_powers[attempt] = have
    return have[0][:n], have[1][:n]


def _distinct(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of a representative of each distinct chunk, number of each chunk's representative)."""
    for attempt in range(64):
        up, down = _powers(attempt, len(data))
        sums = np.zeros(len(data) + 1, _u)
        np.cumsum((data + np.uint16(1)) * up, out=sums[1:])
        name = mix64((sums[begin + size] - sums[begin]) * down[begin] ^ size.astype(_u) << _u(40))
        _, unique, which = np.unique(name, return_index=True, return_inverse=True)
        # Chunks of one name must be the same bytes; if not, another base.
        twin = unique[which]
        if (size == size[twin]).all():
            place = np.arange(len(data))
            if (data == data[place + np.repeat(begin[twin] - begin, size)]).all():
                return unique, which
    raise ValueError("chunks collide under every base")


def encode(docs: DataFrame, vocabulary: Vocabulary, key: Column, text: str = "text", seed: int = SEED) -> DataFrame:
    """Adds ``ids``, a segmentation sampled for the row's ``key``."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("array<int>")
    def sampled(texts: pa.Array, keys: pa.Array) -> pa.Array:
        lattice = Lattice.of(shared.value)
        ids, counts = [], [np.zeros(1, np.int64)]
        batch = pa.RecordBatch.from_arrays([texts, keys], ["text", "key"])
        for part in sliced(batch, "text", SLICE_BYTES):
            data, offsets = text_buffer(part.column("text"))
            found, ends = lattice.sample(data, offsets, part.column("key").to_numpy().view(_u))
            counts.append(ends[1:] + counts[-1][-1])
            ids.append(found)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        out = pa.ListArray.from_arrays(pa.array(np.concatenate(counts), pa.int32()), pa.array(flat, pa.int32()))
        return pc.if_else(pc.is_valid(texts), out, pa.nulls(len(out), out.type)) if texts.null_count else out

    return docs.drop("ids").withColumn("ids", sampled(F.col(text), F.xxhash64(key, F.lit(seed))))


def decode(ids: Column, spark: SparkSession, vocabulary: Vocabulary) -> Column:
    """The text of an array of ids; null for null."""
    shared = spark.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("string")
    def joined(lists: pa.Array) -> pa.Array:
        pieces = shared.value.pieces
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        store, start = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(size) - size
        flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
        length = size[flat]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        data = store[np.repeat(start[flat] - (ends - length), length) + np.arange(total)]
        offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
        try:
            texts = raw.cast(pa.string())
        except pa.ArrowInvalid:  # ids that spell no valid text
            texts = pa.array([v.decode("utf-8", "replace") for v in raw.to_pylist()], pa.string())
        return pc.if_else(pc.is_valid(lists), texts, pa.nulls(len(texts), pa.string())) if lists.null_count else texts

    return joined(ids)
