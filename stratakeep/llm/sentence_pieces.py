"""SentencePiece encoding by rounds of merges over flat arrays, and decoding (operator 12).

The library merges the pair of neighbours with the best score first, and of equal ones the
leftmost, until no pair is a piece. Words that can't influence each other are handled at once: all
symbols of all new words stand in one array, every round finds the best rank of each word's pairs
(a segmented minimum), merges all its leftmost places, and moves the symbols together, until no
pair remains.

A merge can make a pair that ranks as high as the one just merged, or higher. The library then
merges that pair before it goes on to the right. So a round stops in a word behind the first merge
that does so; places too far apart to touch (two lengths of the longest piece) don't wait for it.
"""

from __future__ import annotations

import codecs
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakeep.llm.words import chunks

SPACE = "▁"
_NONE = np.int32(2**31 - 1)
#: Bytes of new words that are merged at once, and words that a task remembers.
_MERGE_BYTES, _MOST_WORDS = 1 << 20, 300_000
#: Texts by which a model is held against the library before it is used.
_PROBES = ("", " ", "  a  b ", "The quick\tbrown\r\n fox's 12,345 [x]", "é́ ﬁ Ａ　\U0001f600\x00", "aaaaaaaaaaaaa bbbbbb------", SPACE + "x " + SPACE * 3, "<s></s><0x0A>", "汉字 مرحبا")


class Model:
    """Pieces of a byte-fallback BPE model, and which pairs of symbols merge into what at which rank.

    A symbol is a piece's id, or above those a character that has no piece but stands in one.
    """

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = library.get_piece_size()
        pieces = [library.id_to_piece(k) for k in range(size)]
        normal = [k for k in range(size) if not (library.is_byte(k) or library.is_control(k) or library.is_unknown(k))]
        of_byte = {int(pieces[k][3:5], 16): k for k in range(size) if library.is_byte(k)}
        if len(of_byte) < 256 or any(library.is_unused(k) for k in normal):
            raise ValueError("the model must fall back on bytes and have no unused pieces")
        self.begin, self.end, self.size = library.bos_id(), library.eos_id(), size
        self.bytes_at = np.array([of_byte[b] for b in range(256)], np.int32)
        symbols = {pieces[k]: k for k in normal}
        for c in sorted(set("".join(symbols)) - symbols.keys()):
            symbols[c] = size + len(symbols) - len(normal)
        # equal scores are of equal rank: the leftmost of them goes first, whatever its piece
        scores = {k: library.get_score(k) for k in normal}
        rank_of = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        single = sorted((ord(p), k) for p, k in symbols.items() if len(p) == 1)
        self.characters, self.character_ids = (np.array(x, np.int64) for x in zip(*single))
        pairs, neighbours = [], set()
        for k in normal:
            p = pieces[k]
            neighbours.update(zip(p, p[1:]))
            for cut in range(1, len(p)):
                a, b = symbols.get(p[:cut]), symbols.get(p[cut:])
                if a is not None and b is not None:
                    pairs.append((a, b, k, rank_of[scores[k]]))
        self.base = size + len(symbols)
        a, b, self.merged, self.rank = np.array(pairs or np.zeros((0, 4)), np.int64).reshape(-1, 4).T
        order = np.argsort(keys := a * self.base + b)
        self.keys, self.merged, self.rank = keys[order], self.merged[order].astype(np.int32), self.rank[order].astype(np.int32)
        # pieces that can be part of one of the same or a better rank
        own = np.full(self.base, _NONE, np.int64)
        own[normal] = [rank_of[scores[k]] for k in normal]
        self.restless = np.zeros(self.base, bool)
        for side in (a[order], b[order]):
            self.restless[side[self.rank <= own[side]]] = True
        self.joined = np.array(sorted(ord(x) << 21 | ord(y) for x, y in neighbours), np.int64)
        self.reach = 2 * max(map(len, symbols), default=1)
        self.inner_space = any(SPACE in p.lstrip(SPACE) for p in symbols)
        self.step = self._blank_step({len(p): scores[k] for p, k in symbols.items() if k in scores and len(p) > 1 and not p.strip(SPACE)}, symbols)
        self.shown = pa.array([b"" if library.is_control(k) else bytes([int(pieces[k][3:5], 16)]) if library.is_byte(k) else pieces[k].replace(SPACE, " ").encode() if k in scores else library.decode([k]).encode() for k in range(size)], pa.binary())
        self.is_control = np.array([library.is_control(k) for k in range(size)])
        self.begins_blank = np.array([p.startswith(SPACE) and k in scores for k, p in enumerate(pieces)])
        for text in _PROBES:
            mine = np.frombuffer(Encoder(self)(pa.array([text]))[0], "<u4").tolist()
            if mine != library.encode(text, add_bos=True, add_eos=True) or self.decode([np.array(mine, np.uint32)])[0].decode() != library.decode(mine):
                raise ValueError(f"not a model of this kind: {text!r} comes out otherwise than in the library")

    def _blank_step(self, runs: dict[int, float], symbols: dict[str, int]) -> int:
        """Where a long run of blanks may be cut: after so many, or 0 for nowhere.

        Runs of blanks that are pieces of one rank merge strictly from the left, each merge waiting
        for the last. If no piece has two blanks and a letter, what is at the left of a long run
        doesn't depend on its end; so if the first step has come off as a piece of its own for all
        lengths from two steps to four, it does for all that are longer.
        """
        step = max(runs, default=0)
        if len(set(runs.values())) != 1 or any(p.startswith(SPACE * 2) and p.strip(SPACE) for p in symbols):
            return 0
        made = lambda n: self.merge(np.full(n, ord(SPACE)), np.zeros(n, np.int64))[0].tolist()
        return step if all(made(n) == made(step) + made(n - step) for n in range(2 * step, 4 * step + 1)) else 0

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of pairs; rank _NONE where they don't merge."""
        wanted = left.astype(np.int64) * self.base + right
        wanted[(left < 0) | (right < 0)] = -1
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        if not len(self.keys):
            return np.full(len(wanted), _NONE), np.zeros(len(wanted), np.int32)
        return np.where(self.keys[at] == wanted, self.rank[at], _NONE), self.merged[at]

    def merge(self, codes: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their words) of characters (code points, the number of each one's word, ascending)."""
        n = len(codes)
        if not n:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.characters, codes), len(self.characters) - 1)
        symbol = np.where(self.characters[at] == codes, self.character_ids[at], -1).astype(np.int32)
        # between characters that no piece has side by side nothing merges: there a segment ends
        pair = codes[:-1] << 21 | codes[1:]
        near = np.searchsorted(self.joined, pair)
        near[near == len(self.joined)] = 0
        tied = (word[1:] == word[:-1]) & ((self.joined[near] == pair) if len(self.joined) else False)
        segment = np.r_[0, np.cumsum(~tied)]
        whole, place, done = symbol.copy(), np.arange(n), np.ones(n, bool)  # done: a symbol begins here
        # the active symbols: their character, symbol, segment, and rank and merged symbol of the pair with the next
        rank, into = self._pairs(symbol, segment)
        while len(place):
            starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(segment)])
            alive = np.repeat(best < _NONE, sizes)
            if not alive.all():
                whole[place] = symbol
                place, symbol, segment, rank, into = (x[alive] for x in (place, symbol, segment, rank, into))
                if not len(place):
                    break
                sizes, best = sizes[best < _NONE], best[best < _NONE]
            chosen = np.flatnonzero(rank == np.repeat(best, sizes))
            # of overlapping places (a a a) every other one, from the left
            run = np.cumsum(np.r_[True, np.diff(chosen) != 1])
            first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
            chosen = chosen[(np.arange(len(chosen)) - first[run - 1]) % 2 == 0]
            chosen = self._until_stirred(chosen, symbol, segment, place, rank, into)
            symbol[chosen] = into[chosen]
            done[place[chosen + 1]] = False
            keep = np.ones(len(place), bool)
            keep[chosen + 1] = False
            moved = np.cumsum(keep) - 1
            place, symbol, segment, rank, into = (x[keep] for x in (place, symbol, segment, rank, into))
            here = moved[chosen]
            before = here[here > 0] - 1
            touched = np.union1d(here, before)
            rank[touched], into[touched] = self._pairs(symbol, segment, touched)
        ids, at = whole[done], np.flatnonzero(done)
        return self._with_bytes(ids, at, codes, word)

    def _pairs(self, symbol: np.ndarray, segment: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each symbol (or those at `at`) with the next of its segment."""
        at = np.arange(len(symbol)) if at is None else at
        after = np.minimum(at + 1, len(symbol) - 1)
        rank, into = self._look_up(symbol[at], symbol[after])
        rank[(segment[after] != segment[at]) | (after == at)] = _NONE
        return rank, into

    def _until_stirred(self, chosen, symbol, segment, place, rank, into) -> np.ndarray:
        """Those of the chosen places that go now: of places near each other, up to the first whose merge makes a pair of the same or a better rank."""
        stirs = np.zeros(len(chosen), bool)
        look = np.flatnonzero(self.restless[into[chosen]])
        if not len(look):
            return chosen
        c = chosen[look]
        new, old = into[c], rank[c]
        follows = np.zeros(len(look), bool)  # the chosen place before it ends where this one begins
        has = look > 0
        follows[has] = chosen[look[has] - 1] == c[has] - 2
        left = np.where(follows, into[np.maximum(c - 2, 0)], symbol[np.maximum(c - 1, 0)])
        with_left = (c > 0) & (segment[np.maximum(c - 1, 0)] == segment[c])
        right = np.minimum(c + 2, len(symbol) - 1)
        with_right = (c + 2 < len(symbol)) & (segment[right] == segment[c])
        stirs[look] = (with_left & (self._look_up(left, new)[0] <= old)) | (with_right & (self._look_up(new, symbol[right])[0] <= old))
        if not stirs.any():
            return chosen
        group = np.cumsum(np.r_[True, (segment[chosen[1:]] != segment[chosen[:-1]]) | (np.diff(place[chosen]) >= self.reach)])
        begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        before = np.cumsum(stirs) - stirs
        return chosen[before == before[begins][group - 1]]

    def _with_bytes(self, ids: np.ndarray, at: np.ndarray, codes: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as the ids of their bytes."""
        words = word[at]
        odd = np.flatnonzero((ids < 0) | (ids >= self.size))
        if not len(odd):
            return ids, words
        raw = [chr(c).encode() for c in codes[at[odd]].tolist()]
        counts = np.ones(len(ids), np.int64)
        counts[odd] = [len(r) for r in raw]
        out = np.repeat(ids, counts)
        first = np.cumsum(counts) - counts
        into = np.repeat(first[odd] - np.r_[0, np.cumsum(counts[odd])[:-1]], counts[odd]) + np.arange(counts[odd].sum())
        out[into] = self.bytes_at[np.frombuffer(b"".join(raw), np.uint8)]
        return out, np.repeat(words, counts)

    def decode(self, rows: list[np.ndarray]) -> list[bytes]:
        """UTF-8 text of each row of ids; the blank that encoding put first goes."""
        sizes = np.array([len(r) for r in rows], np.int64)
        ids = np.concatenate([*rows, np.zeros(0, np.uint32)]).astype(np.int64)
        if len(ids) and (ids >= self.size).any():
            raise ValueError("an id isn't in the vocabulary")
        shown = self.shown.take(pa.array(ids))
        ends = np.r_[0, np.cumsum(sizes)]
        offsets = np.frombuffer(shown.buffers()[1], np.int32)[: len(ids) + 1]
        data = bytes(shown.buffers()[2] or b"")[: int(offsets[-1])]
        heard = ~self.is_control[ids]
        first = np.searchsorted(np.flatnonzero(heard), ends[:-1])
        at = np.r_[np.flatnonzero(heard), len(ids)][first]
        out = []
        for a, b, k in zip(ends[:-1].tolist(), ends[1:].tolist(), at.tolist()):
            text = data[offsets[a] : offsets[b]]
            if k < b and self.begins_blank[ids[k]]:
                text = text[1:]
            out.append(text.decode("utf-8", "stratakeep_each_byte").encode())
        return out


codecs.register_error("stratakeep_each_byte", lambda e: ("�" * (e.end - e.start), e.end))


@lru_cache(1)
def load(path: str) -> Model:
    """The model, made once in a process."""
    return Model(path)


class Encoder:
    """Ids of texts, word by word; what a word became is remembered, for _MOST_WORDS words at most."""

    def __init__(self, model: Model):
        self.model, self.known, self.store = model, {}, []

    def _new(self, words: list[bytes]) -> None:
        """Merge words that aren't known, at most _MERGE_BYTES of them at once (one word at least)."""
        sizes = np.cumsum([len(w) for w in words])
        groups = np.split(np.arange(len(words)), np.flatnonzero(np.diff(sizes // _MERGE_BYTES)) + 1)
        for group in groups:
            part = [words[k].decode().replace(" ", SPACE) for k in group]
            codes = np.frombuffer("".join(part).encode("utf-32-le"), "<u4").astype(np.int64)
            ids, word = self.model.merge(codes, np.repeat(np.arange(len(part)), [len(w) for w in part]))
            data, ends = ids.astype("<u4").tobytes(), np.searchsorted(word, np.arange(len(part) + 1)) * 4
            for k, a, b in zip(group, ends[:-1].tolist(), ends[1:].tolist()):
                self.known[words[k]] = data[a:b]

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """Of each text its ids as little-endian numbers of four bytes, begin and end with them."""
        if len(self.known) > _MOST_WORDS:
            self.known.clear()
        texts = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), SPACE, " ")
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(*(pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in ("", texts, " "))))
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        low = int(bounds[0])
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[low : int(bounds[-1])]
        bounds = bounds - low
        # a word is blanks and what follows up to the next blank: no piece has a blank further on
        blank = data == 32
        begins = blank & ~np.r_[False, blank[:-1]] if len(data) and not self.model.inner_space else np.zeros(len(data), bool)
        begins[bounds[:-1][np.diff(bounds) > 0]] = True
        if (step := self.model.step) and not self.model.inner_space:
            edges = np.flatnonzero(begins | np.r_[False, blank[:-1] & ~blank[1:]] if len(data) else begins)
            length = np.diff(np.r_[edges, len(data)])
            for a, n in zip(*(x[(length > 3 * step) & blank[edges]].tolist() for x in (edges, length))):
                begins[a + step : a + n - 2 * step : step] = True
        starts = np.flatnonzero(begins)
        offsets = np.r_[starts, len(data)].astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        new = [w for w in distinct if w not in self.known]
        if new:
            self._new(new)
        ids = pa.array([self.known[w] for w in distinct], pa.large_binary()).take(words.indices)
        at = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        body = memoryview(ids.buffers()[2] or b"") if len(ids) else memoryview(b"")
        rows = at[np.searchsorted(starts, bounds)].tolist()
        begin, end = (np.array([k], "<u4").tobytes() for k in (self.model.begin, self.model.end))
        return [begin + bytes(body[a:b]) + end for a, b in zip(rows[:-1], rows[1:])]


def _encode(path: str):
    def run(batches):
        encoder = Encoder(load(path))
        for batch in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(encoder(batch.column(1)), pa.binary())], ["doc_id", "ids"])

    return run


def _decode(path: str):
    def run(batches):
        model = load(path)
        for batch in chunks(batches, "ids"):
            rows = [np.frombuffer(r, "<u4") for r in batch.column(0).fill_null(b"").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(model.decode(rows), pa.binary()).cast(pa.string())], [*batch.schema.names[1:], "text"])

    return run


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids) of each row of (doc_id, text): ids with begin and end, unsigned little-endian of four bytes each.

    The same ids as the library's for a byte-fallback BPE model with identity normalisation, which
    is held against the library when it is loaded; other models are an error. Null and empty texts
    are begin and end alone. Repeated rows give repeated rows, an empty table an empty one, other
    columns are left alone. One narrow pass; a task holds half a megabyte of text at once (or one
    text), and the ids of at most about 300,000 words.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encode(model), "doc_id long, ids binary")


def decode(tokens: DataFrame, model: str) -> DataFrame:
    """The other columns of rows of (ids, ...), and text: what the library's decode gives for ids, null ids as none.

    Control ids are silent, the blank that encoding put first goes, bytes that aren't UTF-8 become
    U+FFFD each. A column named text is replaced. An id outside of the vocabulary is an error.
    """
    more = [c for c in tokens.columns if c not in ("ids", "text")]
    rows = tokens.select("ids", *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(more)])  # mapInArrow can't take names with dots
    return rows.mapInArrow(_decode(model), rows.drop("ids").withColumn("text", F.lit("")).schema).toDF(*more, "text")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row: encoded, and decoded from the ids alone."""
    counted = encode(docs, model).select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return decode(counted, model).select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))
