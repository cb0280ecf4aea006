"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text gets a leading blank and is cut into units, a run of blanks with the word behind it; no piece of such a
vocabulary crosses a unit's start.  Distinct units of a block are laid out as one flat symbol array.  Each round
finds the best pair rank of every unit, merges all its leftmost occurrences at once and compacts, until no unit
has a pair left.  Where merging all occurrences would form a better pair, only the leftmost is merged, so the
result is the sequential one.  Symbols outside the vocabulary become byte pieces.

Edge cases: null and empty texts have no ids; every text is taken whole; repeated rows each come out; further
columns are carried, except those named ids; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm.common import blocks, distinct_ranges, leading, ragged, table

BLANK = "▁"
#: Bytes of text encoded at once: the more, the more often a unit is shared.
ENCODE_BYTES = 2 << 20
_NONE = np.int64(1 << 40)
_MODELS: dict[int, "Pieces"] = {}


class Pieces:
    """Lookup tables of a model: pair to rank and merged piece, character to piece, piece to bytes."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        self.size = n
        self.byte_id = np.zeros(256, np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_id[int(names[i][3:5], 16)] = i
        ids = {p: i for i, p in enumerate(names) if not special[i]}
        if any(BLANK in p.lstrip(BLANK) for p in ids):
            raise ValueError("a piece holds a blank behind other characters; units would not be independent")
        self.char = np.arange(0x110000, dtype=np.int32) + n  # n + code point: not in the vocabulary
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        loose = {p for p in ids if len(p) > 1 and any(c not in ids for c in p)}
        if loose:
            raise ValueError("pieces with characters that are not pieces themselves")
        scores = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in ids.values()}, reverse=True))}
        count: dict[float, int] = {}
        for i in ids.values():
            count[sp.get_score(i)] = count.get(sp.get_score(i), 0) + 1
        self.rank_tied = np.zeros(len(scores), bool)
        for s, c in count.items():
            self.rank_tied[scores[s]] = c > 1
        keys, ranks, merged = [], [], []
        for p, i in ids.items():
            for cut in range(1, len(p)):
                a, b = ids.get(p[:cut]), ids.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    ranks.append(scores[sp.get_score(i)])
                    merged.append(i)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.ranks = np.append(np.array(ranks, np.int64)[order], _NONE)
        self.merged = np.append(np.array(merged, np.int32)[order], -1)
        # a first test by hash, as most pairs are not in the table
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self._slot(self.keys[:-1])] = True
        # what a piece decodes to
        text = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else b" \xe2\x81\x87 " if sp.is_unknown(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(names)]
        self.out_len = np.array([len(t) for t in text], np.int64)
        self.out_at = np.cumsum(self.out_len) - self.out_len
        self.out = np.frombuffer(b"".join(text), np.uint8)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or _NONE) and table position of each pair."""
        key = left.astype(np.int64) << np.int64(32) | right
        rank = np.full(len(key), _NONE)
        at = np.zeros(len(key), np.int64)
        some = np.flatnonzero(self.maybe[self._slot(key)])
        pos = np.searchsorted(self.keys, key[some])
        hit = self.keys[pos] == key[some]
        rank[some[hit]] = self.ranks[pos[hit]]
        at[some[hit]] = pos[hit]
        return rank, at


def pieces_of(model: bytes) -> Pieces:
    key = hash(model)
    if key not in _MODELS:
        _MODELS[key] = Pieces(model)
    return _MODELS[key]


def _first_of_runs(flag: np.ndarray) -> np.ndarray:
    """Of each run of True every other one, from the first."""
    at = np.flatnonzero(flag)
    if not len(at):
        return at
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1] + 1
    begin = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    return at[(np.arange(len(at)) - begin) % 2 == 0]


def merge_rounds(p: Pieces, sym: np.ndarray, unit: np.ndarray, n_units: int) -> tuple[np.ndarray, np.ndarray]:
    """Final symbols and their units (0 to n_units - 1, ascending) of flat initial symbols."""
    done_sym, done_unit = [], []
    rank, at = p.look_up(sym[:-1], sym[1:])
    rank[unit[1:] != unit[:-1]] = _NONE
    rank, at = np.append(rank, _NONE), np.append(at, 0)
    while len(sym):
        start = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        best = np.minimum.reduceat(rank, start)
        width = np.diff(np.append(start, len(sym)))
        over = best == _NONE
        if over.any():
            gone = np.repeat(over, width)
            done_sym.append(sym[gone])
            done_unit.append(unit[gone])
            sym, unit, rank, at = sym[~gone], unit[~gone], rank[~gone], at[~gone]
            best, width = best[~over], width[~over]
            if not len(sym):
                break
        group = np.repeat(np.arange(len(best)), width)
        chosen = _first_of_runs(rank == best[group])
        g = group[chosen]
        lead = np.ones(len(chosen), bool)
        lead[1:] = g[1:] != g[:-1]
        chosen = chosen[lead | ~p.rank_tied[best[g]]]
        while True:
            merged = sym.copy()
            merged[chosen] = p.merged[at[chosen]]
            keep = np.ones(len(sym), bool)
            keep[chosen + 1] = False
            new_sym, new_unit, new_group = merged[keep], unit[keep], group[keep]
            new_rank, new_at = rank[keep], at[keep]
            place = np.cumsum(keep) - 1
            fresh = np.zeros(len(new_sym) + 1, bool)
            fresh[place[chosen]] = True
            fresh[place[chosen] - 1] = True  # of the very first symbol: the spare last place
            fresh[len(new_sym) - 1 :] = False
            ok = np.flatnonzero(fresh)
            r, a = p.look_up(new_sym[ok], new_sym[ok + 1])
            r[new_unit[ok] != new_unit[ok + 1]] = _NONE
            new_rank[ok], new_at[ok] = r, a
            new_rank[-1] = _NONE
            g = group[chosen]
            lead = np.ones(len(chosen), bool)
            lead[1:] = g[1:] != g[:-1]
            if lead.all():
                break
            bad = np.zeros(len(best), bool)
            bad[new_group[ok][r < best[new_group[ok]]]] = True
            if not bad[g[~lead]].any():
                break
            chosen = chosen[lead | ~bad[g]]
        sym, unit, rank, at = new_sym, new_unit, new_rank, new_at
    if not done_sym:
        return sym, unit
    out_sym, out_unit = np.concatenate(done_sym), np.concatenate(done_unit)
    order = np.argsort(out_unit, kind="stable")
    return out_sym[order], out_unit[order]


def byte_fallback(p: Pieces, sym: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols outside the vocabulary, as the byte pieces of their UTF-8 form."""
    far = np.flatnonzero(sym >= p.size)
    if not len(far):
        return sym, unit
    cp = sym[far] - p.size
    n = 1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF)
    raw = np.frombuffer(cp.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
    count = np.ones(len(sym), np.int64)
    count[far] = n
    wide = np.repeat(sym, count)
    wide[ragged((np.cumsum(count) - count)[far], n)] = p.byte_id[raw]
    return wide, np.repeat(unit, count)


def encode_block(p: Pieces, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of all texts, and each text's number of ids."""
    blank = BLANK.encode()
    texts = [b" " + (t.replace(blank, b" ") if blank in t else t) if t else b"" for t in texts]
    data = np.frombuffer(b"".join(texts), np.uint8)
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    offs = np.concatenate([[0], np.cumsum(lens)])
    gap = data == 32
    before = np.concatenate([[False], gap[:-1]])
    before[offs[:-1][lens > 0]] = False
    starts = np.flatnonzero(gap & ~before)
    ends = np.append(starts[1:], len(data))
    first, back = distinct_ranges(data, starts, ends)
    flat = data[ragged(starts[first], (ends - starts)[first])]
    unit = np.repeat(np.arange(len(first)), (ends - starts)[first])[(flat & 0xC0) != 0x80]
    code = np.frombuffer(flat.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    sym = p.char[np.where(code == 32, np.uint32(ord(BLANK)), code)]
    sym, unit = byte_fallback(p, *merge_rounds(p, sym, unit, len(first)))
    count = np.bincount(unit, minlength=len(first))
    begin = np.cumsum(count) - count
    ids = sym[ragged(begin[back], count[back])]
    total = np.concatenate([[0], np.cumsum(count[back])])
    of = np.searchsorted(starts, offs)  # each text's first unit
    return ids, total[of[1:]] - total[of[:-1]]


def decode_block(p: Pieces, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The texts of flat ids: pieces joined, blanks restored, the leading one dropped."""
    n = p.out_len[ids]
    raw = p.out[ragged(p.out_at[ids], n)].tobytes()
    end = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
    out = []
    for a, b in zip(end[:-1], end[1:]):
        t = raw[a + 1 : b] if raw[a : a + 1] == b" " and b > a else raw[a:b]
        out.append(t)
    return out


def _model(spark: SparkSession, path: str | None):
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:  # a vocabulary file beside the driver, of fixed size
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """docs with ids array<int>."""
    model = _model(docs.sparkSession, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(model.value)
        for batch in batches:
            rest = pa.RecordBatch.from_arrays(batch.columns[1:], names=batch.schema.names[1:])
            for a, b, data, offs in blocks(batch.column(0), ENCODE_BYTES):
                raw = data.tobytes()
                ids, counts = encode_block(p, [raw[i:j] for i, j in zip(offs[:-1].tolist(), offs[1:].tolist())])
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*rest.slice(a, b - a).columns, lists], names=[*rest.schema.names, "ids"])

    rest = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("text", "ids")])
    fields = "".join(f"`{c}` {t}, " for c, t in rest.dtypes)
    return leading(docs, "text", rest.columns).mapInArrow(run, fields + "ids array<int>")


def decode(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """The frame with text, decoded from its column ids."""
    model = _model(encoded.sparkSession, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(model.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                lists = part.column(0).fill_null([])
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                counts = np.diff(lists.offsets.to_numpy())
                texts = [t.decode("utf-8", "replace") for t in decode_block(p, ids, counts)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string())], names=[*part.schema.names[1:], "text"])

    rest = encoded.select(*[F.col(f"`{c}`") for c in encoded.columns if c != "text"])
    fields = "".join(f"`{c}` {t}, " for c, t in rest.dtypes)
    return leading(encoded, "ids", rest.columns).mapInArrow(run, fields + "text string")


def digests(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """docs without text, with n_tokens, ids_sha256 and decoded_sha256: encoded and decoded in one pass.

    The ids themselves would be the largest column by far, so the pass keeps them inside the task.
    """
    model = _model(docs.sparkSession, model_path)
    new = ("n_tokens", "ids_sha256", "decoded_sha256")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(model.value)
        name = [b"%d" % i for i in range(p.size)]
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for _, _, data, offs in blocks(batch.column(0), ENCODE_BYTES):
                raw = data.tobytes()
                ids, counts = encode_block(p, [raw[i:j] for i, j in zip(offs[:-1].tolist(), offs[1:].tolist())])
                texts = decode_block(p, ids, counts)
                text_sha += [hashlib.sha256(t).hexdigest() for t in texts]
                at = np.concatenate([[0], np.cumsum(counts)]).tolist()
                flat = ids.tolist()
                ids_sha += [hashlib.sha256(b",".join([name[i] for i in flat[a:b]])).hexdigest() for a, b in zip(at[:-1], at[1:])]
                n += counts.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=[*batch.schema.names[1:], *new])

    rest = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "text" and c not in new])
    fields = "".join(f"`{c}` {t}, " for c, t in rest.dtypes)
    return leading(docs, "text", rest.columns).mapInArrow(run, fields + "n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
