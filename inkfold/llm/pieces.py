"""SentencePiece encoding and decoding by suffix-array matching and relaxation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import extended, slices, table, text_buffer, with_columns

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text that are indexed together: the arrays of a batch take about 80 bytes for each. A longer text is cut where its
#: ids do not change; a unit that cannot be cut is indexed window by window.
BATCH = 1_000_000
_UNITS = re.compile(rb"\n| ?[^ \n]+| ")
#: The place before a newline or before a space that stands between two words: units begin there.
_SAFE = re.compile(rb"[^ \n](?=\n)|[^ \n\x81](?= [^ \n\xe2])")
_LONG_UNIT = 256
_SPACE = "▁"
_CACHE = 1 << 20
_FAR = np.int64(1 << 40)


def _last_merge(piece: str, rank: dict[str, int]) -> tuple[str, str] | None:
    """The two pieces whose merge ends in this piece, when the best-ranked neighbours merge first."""
    parts: list[str] = list(piece)
    while len(parts) > 2:
        at = min(range(len(parts) - 1), key=lambda i: (rank.get(parts[i] + parts[i + 1], _FAR), i))
        if parts[at] + parts[at + 1] not in rank:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def load(path: str = MODEL) -> dict:
    """The tables of a byte-fallback BPE model with identity normalisation and a dummy prefix (bounded by its vocabulary).
    Spaces stand for themselves; pieces of several spaces are kept apart, as they merge last."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.vocab_size()
    bytes_at = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(size) if model.is_byte(i)}
    plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    name = {i: model.id_to_piece(i).replace(_SPACE, " ") for i in plain}
    spaces = {len(n): i for i, n in name.items() if not n.strip(" ")}
    usable = [i for i in plain if len(name[i]) == 1 or name[i].strip(" ")]
    order = sorted((i for i in usable if len(name[i]) > 1), key=lambda i: -model.get_score(i))
    rank = {name[i]: k for k, i in enumerate(order)}
    ids = {name[i]: i for i in usable}
    left, right, ranks, reachable = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.full(size + 1, -1, np.int64), []
    joined: dict[int, int] = {}
    for i in usable:
        text = name[i]
        if len(text) > 1:
            merge = _last_merge(text, rank)
            if merge is None:
                continue
            left[i], right[i], ranks[i] = ids[merge[0]], ids[merge[1]], rank[text]
            for k in range(1, len(text)):
                if text[:k] in ids and text[k:] in ids:
                    joined[ids[text[:k]] * size + ids[text[k:]]] = rank[text]
        reachable.append(i)
    keys = np.array(sorted(joined), np.int64)
    surface = [b""] * size
    for i in plain:
        surface[i] = name[i].encode()
    for b, i in bytes_at.items():
        surface[i] = bytes([b])
    inside = {name[i][k : k + 2] for i in usable for k in range(len(name[i]) - 1)}
    wanted = sorted((name[i].encode(), i) for i in reachable)
    return {
        "size": size, "left": left, "right": right, "rank": ranks, "pair": keys, "pair_rank": np.array([joined[k] for k in keys.tolist()] + [0], np.int64),
        "pieces": [p for p, _ in wanted], "piece_ids": np.array([i for _, i in wanted], np.int32), "single": np.array([len(p.decode()) == 1 for p, _ in wanted]),
        "bytes": np.array([bytes_at[b] for b in range(256)], np.int32), "spaces": spaces, "surface": surface, "inside": inside,
    }


class Encoder:
    """Encodes batches of texts; holds a cache of which pieces may follow each other."""

    def __init__(self, tables: dict):
        self.t = tables
        self.held, self.fine = np.full(_CACHE, -1, np.int64), np.zeros(_CACHE, bool)
        lengths = np.array([len(p) for p in tables["pieces"]])
        head = lambda fill, at: np.array([p[at : at + 8].ljust(8, fill) for p in tables["pieces"]]).astype("S8")
        number = lambda cells: np.frombuffer(b"".join(bytes(c).ljust(8, b"\0") for c in cells.tolist()), ">u8").astype(np.uint64)
        self.lengths, self.low, self.high = lengths, number(head(b"\0", 0)), number(head(b"\xff", 0))
        self.low2, self.high2 = number(head(b"\0", 8)), number(head(b"\xff", 8))
        self.span = np.zeros(tables["size"] + 1, np.int64)
        self.span[tables["piece_ids"]] = lengths
        self.span[tables["bytes"]] = 1

    def may_follow(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether encoding the two pieces' joined text gives these two pieces back; `size` as first: a unit's start."""
        key = first * np.int64(self.t["size"] + 1) + second
        slot = (key * 40503 + (key >> 15)) & (_CACHE - 1)
        known = self.held[slot] == key
        out = self.fine[slot]
        if not known.all():
            ask = np.unique(key[~known])
            found = self._compatible(ask // (self.t["size"] + 1), ask % (self.t["size"] + 1))
            out[~known] = found[np.searchsorted(ask, key[~known])]
            at = (ask * 40503 + (ask >> 15)) & (_CACHE - 1)
            self.held[at], self.fine[at] = ask, found
        return out

    def _compatible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Walk back through the merges of both pieces: at no time may the two symbols at the seam merge before either is
        used up by its own piece (of equal ranks the left merge goes first)."""
        t, size = self.t, self.t["size"]
        fine = np.ones(len(x), bool)
        live = np.nonzero(x < size)[0]
        x, y = x[live].copy(), y[live].copy()
        px, py = np.full(len(x), _FAR), np.full(len(x), _FAR)
        while len(live):
            code = x * size + y
            at = np.searchsorted(t["pair"], code)
            met = np.where(t["pair"][np.minimum(at, len(t["pair"]) - 1)] == code, t["pair_rank"][at], _FAR)
            bad = (met < px) & (met <= py)
            fine[live[bad]] = False
            rx, ry = t["rank"][x], t["rank"][y]
            back = rx > ry
            go = ~bad & ((rx >= 0) | (ry >= 0))
            px, py = np.where(back, rx, px), np.where(back, py, ry)
            x, y = np.where(back, t["right"][x], x), np.where(back, y, t["left"][y])
            live, x, y, px, py = live[go], x[go], y[go], px[go], py[go]
        return fine

    def _edges(self, buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Begin and piece of every occurrence of a piece: ranges of the suffixes of the text, sorted by 16 bytes."""
        n = len(buffer)
        eight = np.ndarray((n + 9,), ">u8", buffer + b"\0" * 16, strides=(1,)).astype(np.uint64)
        k1, k2 = eight[:n], eight[8 : n + 8]
        suffix = np.lexsort((k2, k1)).astype(np.int32)
        k1, k2 = k1[suffix], k2[suffix]
        lo, hi = np.searchsorted(k1, self.low), np.searchsorted(k1, self.high, "right")
        for i in np.nonzero((self.lengths > 8) & (hi > lo))[0]:
            part = k2[lo[i] : hi[i]]
            lo[i], hi[i] = lo[i] + np.searchsorted(part, self.low2[i]), lo[i] + np.searchsorted(part, self.high2[i], "right")
        counts = hi - lo
        piece = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        begin = suffix[np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts - lo, counts)]
        if (self.lengths > 16).any():
            far = np.nonzero(self.lengths[piece] > 16)[0]
            wrong = [k for k in far if buffer[begin[k] : begin[k] + self.lengths[piece[k]]] != self.t["pieces"][piece[k]]]
            begin, piece = np.delete(begin, wrong), np.delete(piece, wrong)
        return begin, piece

    def _occurrences(self, buffer: bytes, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and id of every occurrence of a piece in the units of a buffer. A character that is no piece falls back to its
        bytes; the separators behind units have no edge."""
        raw = np.frombuffer(buffer, np.uint8)
        begin, piece = self._edges(buffer)
        covered = np.zeros(len(raw) + 4, bool)
        covered[begin[self.t["single"][piece]]] = True
        inside = np.ones(len(raw), bool)
        inside[starts + lengths] = False
        lead = (raw & 0xC0) != 0x80
        alone = np.nonzero(inside & ~covered[np.maximum.accumulate(np.where(lead, np.arange(len(raw)), 0))])[0].astype(np.int32)
        return np.concatenate([begin, alone]), np.concatenate([self.t["piece_ids"][piece], self.t["bytes"][raw[alone]]])

    def _relax(self, last: np.ndarray, begin: np.ndarray, token: np.ndarray, step: np.ndarray) -> None:
        """Admit edges in order of step: last holds the piece that ends at each place (-1: none does)."""
        order = np.argsort(step.astype(np.uint16) if len(step) and step.max() < 65536 else step, kind="stable")
        begin, token = begin[order], token[order].astype(np.int64)
        bounds = np.searchsorted(step[order], np.arange((int(step.max()) if len(step) else 0) + 2))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            here = last[begin[a:b]]
            got = np.nonzero(here >= 0)[0]
            src, tok = begin[a:b][got], token[a:b][got]
            ok = self.may_follow(here[got].astype(np.int64), tok)
            last[src[ok] + self.span[tok[ok]]] = tok[ok]

    def _long_unit(self, unit: bytes) -> np.ndarray:
        """Ids of one unit, whose occurrences are indexed a window at a time."""
        raw, n, reach = np.frombuffer(unit, np.uint8), len(unit), int(self.lengths.max()) + 4
        last = np.full(n + reach + 1, -1, np.int32)
        last[0], at = self.t["size"], 0
        while at < n:
            to = min(n, at + BATCH)
            while to < n and raw[to] & 0xC0 == 0x80:
                to -= 1
            window = unit[at : to + reach]
            begin, token = self._occurrences(window + b"\0", np.zeros(1, np.int64), np.array([len(window)]))
            mine = begin < to - at
            self._relax(last[at:], begin[mine], token[mine], begin[mine])
            at = to
        out = []
        while at > 0:
            out.append(last[at])
            at -= int(self.span[last[at]])
        return np.array(out[::-1], np.int32)

    def units(self, distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every distinct unit one after the other, and their offsets."""
        long = {i: self._long_unit(u) for i, u in enumerate(distinct) if len(u) > BATCH}
        if long:
            ids, at = self.units([b"" if i in long else u for i, u in enumerate(distinct)])
            parts = [long.get(i, ids[at[i] : at[i + 1]]) for i in range(len(distinct))]
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        buffer = b"\0".join(distinct) + b"\0"
        lengths = np.fromiter(map(len, distinct), np.int64, len(distinct))
        starts = np.cumsum(lengths + 1) - (lengths + 1)
        begin, token = self._occurrences(buffer, starts, lengths)
        last = np.full(len(buffer) + 1, -1, np.int32)
        last[starts] = self.t["size"]
        self._relax(last, begin, token, (begin - np.repeat(starts, lengths + 1)[begin]).astype(np.int32))
        at, who, found = starts + lengths, np.arange(len(distinct)), []
        while len(who):
            open_ = at > starts[who]
            who, at = who[open_], at[open_]
            tok = last[at]
            found.append((who, tok))
            at = at - self.span[tok]
        counts = np.bincount(np.concatenate([w for w, _ in found]), minlength=len(distinct)) if found else np.zeros(len(distinct), np.int64)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        out = np.zeros(int(offsets[-1]), np.int32)
        for step, (w, tok) in enumerate(found):
            out[offsets[w + 1] - 1 - step] = tok
        return out, offsets

    def _cut(self, unit: bytes) -> list[bytes]:
        """A long unit in parts: no piece holds the two characters beside a cut, so nothing merges across it."""
        chars = unit.decode()
        inside = self.t["inside"]
        cuts = [0, *[k for k in range(1, len(chars)) if chars[k - 1 : k + 1] not in inside], len(chars)]
        return [chars[a:b].encode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def parts(self, text: bytes) -> Iterator[bytes]:
        """A text in parts of about BATCH bytes, cut before a newline or before a space between two words."""
        begin = 0
        while len(text) - begin > BATCH:
            found = _SAFE.search(text, begin + BATCH)
            if not found:
                break
            yield text[begin : found.start() + 1]
            begin = found.start() + 1
        yield text[begin:]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, and their offsets."""
        if any(len(x) > BATCH for x in texts) and len(texts) > 1:
            each = [self.encode([x]) for x in texts]
            return np.concatenate([ids for ids, _ in each]), np.concatenate([[0], np.cumsum([at[1] for _, at in each])])
        if texts and len(texts[0]) > BATCH:
            done = [self._encoded([p], [k == 0])[0] for k, p in enumerate(self.parts(texts[0]))]
            ids = np.concatenate(done)
            return ids, np.array([0, len(ids)])
        return self._encoded(texts, [True] * len(texts))

    def _encoded(self, texts: list[bytes], first: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """As encode(); a text that is the first part of its own gets the dummy prefix."""
        index: dict[bytes, int] = {}
        refs, ends = [], []
        for text, lead in zip(texts, first, strict=True):
            if text:
                for u in _UNITS.findall((b" " if lead else b"") + text.replace(b"\xe2\x96\x81", b" ")):
                    refs += [index.setdefault(x, len(index)) for x in (self._cut(u) if len(u) > _LONG_UNIT else (u,))]
            ends.append(len(refs))
        if not index:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        ids, at = self.units(list(index))
        ref = np.array(refs, np.int64)
        counts = at[ref + 1] - at[ref]
        done = np.concatenate([[0], np.cumsum(counts)])
        out = ids[np.arange(done[-1]) - np.repeat(done[:-1] - at[ref], counts)]
        return self._spaces(out, np.concatenate([[0], done[np.array(ends, np.int64)]]))

    def _spaces(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of single spaces merge from the left into the longest pieces of spaces."""
        sizes, one = self.t["spaces"], self.t["spaces"].get(1, -1)
        most = max(sizes, default=1)
        same = np.nonzero((ids[1:] == one) & (ids[:-1] == one))[0]
        if most < 2 or not len(same):
            return ids, offsets
        texts = np.unique(np.searchsorted(offsets, same, "right") - 1)
        parts, before, lengths = [], 0, np.diff(offsets)
        for i in texts:
            parts.append(ids[before : offsets[i]])
            new, run = [], 0
            for x in [*ids[offsets[i] : offsets[i + 1]].tolist(), -1]:
                if x == one:
                    run += 1
                    continue
                while run:
                    take = max(k for k in sizes if k <= run)
                    new.append(sizes[take])
                    run -= take
                new.append(x)
            parts.append(np.array(new[:-1], np.int32))
            lengths[i], before = len(new) - 1, offsets[i + 1]
        return np.concatenate([*parts, ids[before:]]), np.concatenate([[0], np.cumsum(lengths)])


def decoded(ids: list[int], surface: list[bytes]) -> bytes:
    """The text of ids: the pieces' bytes without the dummy prefix; ill-formed UTF-8 becomes U+FFFD."""
    out = b"".join([surface[i] for i in ids])
    return out[1:] if out[:1] == b" " else out


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """docs with all their columns and ids array<int>, n_tokens long, round_trip boolean (decoding gives the text back).

    The ids are those of the model's own library. The method relaxes all occurrences of pieces in order of position; as the
    model is a byte-pair one, an edge is admitted if its piece may follow the piece that ends where it begins, of which
    there is exactly one. Texts of any length are encoded whole, in bounded memory; equal texts get equal ids, and each of
    repeated rows is encoded. A null or empty text has no ids; U+2581 encodes as a space, as in the library, and is the one
    character that does not round-trip. Columns of these names are replaced; no rows give no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model))  # bounded by the vocabulary: about 4 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        surface = encoder.t["surface"]
        for whole in batches:
            for batch in slices(whole, "text", BATCH):
                raw, at = text_buffer(batch.column("text"))
                data = raw.tobytes()
                texts = [data[at[i] : at[i + 1]] for i in range(batch.num_rows)]
                ids, offsets = encoder.encode(texts)
                listed = ids.tolist()
                same = [decoded(listed[offsets[i] : offsets[i + 1]], surface) == x for i, x in enumerate(texts)]
                yield with_columns(batch, ids=pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)), n_tokens=pa.array(np.diff(offsets)), round_trip=pa.array(same, pa.bool_()))

    return docs.mapInArrow(run, extended(docs, ids="array<int>", n_tokens="long", round_trip="boolean"))


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """rows with all their columns and `text` decoded from `ids`; null ids give a null text, no ids an empty one."""
    shared = rows.sparkSession.sparkContext.broadcast(load(model)["surface"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decoded(x, shared.value).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield with_columns(batch, text=pa.array(texts, pa.string()))

    return rows.mapInArrow(run, extended(rows, text="string"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens", "round_trip", "ids")
