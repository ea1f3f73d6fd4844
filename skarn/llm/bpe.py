"""Byte-pair encoding and decoding by a pair occurrence index (operator 1), and the tokenizer that others share.

The distinct words of a part of a partition that no part before it had are laid out as one linked symbol sequence. An index maps every
mergeable pair to all positions where it occurs. Active ranks are applied in ascending order, and only the lists of
the neighbouring pairs are updated. Consecutive ranks of which none uses the token of another form a wave (122 waves for
50,000 merges): their lists lie together and are merged at once, overlapping occurrences by rank and then from the left.
So each word sees its own lowest rank first, and the result is that of merging each word alone.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import give_back

#: The pre-token patterns of the two public vocabularies.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bytes of text that are encoded together; bounds memory, however long texts are.
PART = 2 << 20
#: Words whose ids are kept for later parts, and their bytes; what doesn't fit is merged again wherever it occurs.
KNOWN_WORDS, KNOWN_BYTES = 1 << 18, 4 << 20


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(shifted)) for b in range(256)]


class Bpe:
    """A BPE vocabulary read from a ``tokenizers`` JSON file of byte-level kind."""

    def __init__(self, spec: dict):
        model = spec["model"]
        unsupported = [k for k in ("dropout", "unk_token", "continuing_subword_prefix") if model.get(k)]
        if model["type"] != "BPE" or unsupported or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError(f"unsupported BPE options: {unsupported or model['type']}")
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.added = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in spec.get("added_tokens", [])):
            raise ValueError("unsupported added-token options")
        if any(c.isspace() for t in self.added for c in t):
            raise ValueError("an added token holds white space")
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.size = 1 + max([*vocab.values(), *self.added.values()])
        alphabet = byte_alphabet()
        self.first = np.array([vocab[c] for c in alphabet], np.int32)
        self.last = np.array([vocab[c + self.suffix] for c in alphabet], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # A pair whose parts or whole are not in the vocabulary can't be applied.
        known = [(r, vocab[a], vocab[b], vocab[a + b]) for r, (a, b) in enumerate(merges)]
        rank, left, right, new = (np.array(x, np.int64) for x in zip(*known))
        self.left, self.right, self.new = left.astype(np.int32), right.astype(np.int32), new.astype(np.int32)
        self.tables = self._tables(left * self.size + right, rank.astype(np.int32))
        back = {c: b for b, c in enumerate(alphabet)}
        self.bytes_of = [b""] * self.size
        self.text_of = [""] * self.size
        self.decimal = list(map(str, range(self.size)))
        for t, i in vocab.items():
            self.text_of[i] = t
            t = t[: -len(self.suffix)] if self.suffix and t.endswith(self.suffix) else t
            self.bytes_of[i] = bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
        for t, i in self.added.items():
            self.text_of[i], self.bytes_of[i] = t, t.encode()
        made: dict[int, int] = {}
        for r, _, _, n in known:
            if made.setdefault(n, r) != r:
                raise ValueError("two merges make the same token; ascending ranks would not be exact")
        if any(max(made.get(a, -1), made.get(b, -1)) >= r for r, a, b, _ in known):
            raise ValueError("a merge comes before those that make its parts")
        self.wave = np.zeros(len(known) + 1, np.int16)  # of each rank; the last one stands for "no merge"
        first = wave = 0
        for k, (_, a, b, _) in enumerate(known):
            if max(made.get(a, -1), made.get(b, -1)) >= rank[first]:
                first, wave = k, wave + 1
            self.wave[k] = wave
        self.waves = wave + 1
        self.wave[-1] = self.waves
        if rank.tolist() != list(range(len(known))):
            raise ValueError("ranks are not consecutive")
        self.known: tuple | None = None  # words, their ids one after another, and the ends of these

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": None}

    @classmethod
    def from_file(cls, path: str) -> Bpe:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    @staticmethod
    def _slot(key: np.ndarray, k: int, bits: int) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64((0x9E3779B97F4A7C15 + 0x632BE59BD9B4E01A * k) % 2**64)) >> np.uint64(64 - bits)

    def _tables(self, keys: np.ndarray, ranks: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Hash tables of pairs: one entry a slot, what collides goes to the next table."""
        out = []
        self.bits = max(4, (4 * len(keys)).bit_length())
        while len(keys):
            slot = self._slot(keys, len(out), self.bits)
            _, own = np.unique(slot, return_index=True)
            key, rank = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
            key[slot[own]], rank[slot[own]] = keys[own], ranks[own]
            out.append((key, rank))
            keys, ranks = np.delete(keys, own), np.delete(ranks, own)
        return out

    # --- pair occurrence index ---

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1."""
        key = a.astype(np.int64) * self.size + b
        out = np.full(len(key), -1, np.int32)
        rest = None  # those that no table has had yet
        for k, (keys, ranks) in enumerate(self.tables):
            slot = self._slot(key, k, self.bits)
            found = keys[slot] == key
            if rest is None:
                out[found] = ranks[slot[found]]
                rest = np.flatnonzero(~found)
            else:
                out[rest[found]] = ranks[slot[found]]
                rest = rest[~found]
            key = key[~found]
        return out

    @staticmethod
    def choose(p: np.ndarray, q: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of occurrences in order, those to merge now, and those that may still be merged after them.

        An occurrence goes before those that it overlaps if its rank is lower, or equal and it stands to the left.
        In a run of overlapping occurrences of one rank every second one is merged.
        """
        touch = q[:-1] == p[1:]
        if not touch.any():
            return np.ones(len(p), bool), np.zeros(len(p), bool)
        same = touch & (rank[:-1] == rank[1:])
        head = np.concatenate([[True], ~same])
        run = np.flatnonzero(head)
        nth = np.arange(len(p)) - np.repeat(run, np.diff(np.concatenate([run, [len(p)]])))
        lower_right = np.concatenate([touch & (rank[1:] < rank[:-1]), [False]])
        lower_left = np.concatenate([[False], touch & (rank[:-1] < rank[1:])])
        blocked = np.repeat(lower_left[run], np.diff(np.concatenate([run, [len(p)]])))
        take = (nth % 2 == 0) & ~blocked & ~lower_right
        gone = take.copy()
        gone[1:] |= touch & take[:-1]
        gone[:-1] |= touch & take[1:]
        return take, ~gone

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and the offsets of the words in them (one more than words)."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        return self.encode_bytes(np.frombuffer(b"".join(words), np.uint8), np.cumsum(lens))

    def encode_bytes(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of words that lie one after another in ``data`` up to ``ends``."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(ends) + 1, np.int64)
        tails = ends[np.diff(ends, prepend=0) > 0] - 1
        sym = self.first[data]
        sym[tails] = self.last[data[tails]]
        nxt = np.arange(1, n + 1, dtype=np.int32)
        prv = np.arange(-1, n - 1, dtype=np.int32)
        nxt[tails] = -1
        prv[tails[:-1] + 1] = -1
        index: list[list[np.ndarray]] = [[] for _ in range(self.waves)]

        def post(pos: np.ndarray) -> None:
            """Enter the pairs that begin at these positions."""
            wave = self.wave[self.rank_of(sym[pos], sym[nxt[pos]])]
            live = wave < self.waves
            pos, wave = pos[live], wave[live]
            if not len(pos):
                return
            order = np.argsort(wave, kind="stable")
            pos, wave = pos[order], wave[order]
            cuts = np.flatnonzero(wave[1:] != wave[:-1]) + 1
            starts = [0, *cuts.tolist(), len(pos)]
            for w, i, j in zip(wave[starts[:-1]].tolist(), starts, starts[1:]):
                index[w].append(pos[i:j])

        post(np.flatnonzero(nxt >= 0).astype(np.int32))
        for wave in range(self.waves):
            lists, index[wave] = index[wave], []
            if not lists:
                continue
            p = np.sort(np.concatenate(lists))
            p = p[np.concatenate([[True], p[1:] != p[:-1]])]
            p = p[(sym[p] >= 0) & (nxt[p] >= 0)]
            q = nxt[p]
            rank = self.rank_of(sym[p], sym[q])
            live = self.wave[rank] == wave
            p, q, rank = p[live], q[live], rank[live]
            merged = []
            while len(p):
                take, rest = self.choose(p, q, rank)
                a, b = p[take], q[take]
                nn = nxt[b]
                sym[a] = self.new[rank[take]]
                sym[b] = -1
                nxt[a] = nn
                right = nn >= 0
                prv[nn[right]] = a[right]
                merged.append(a)
                p, q, rank = p[rest], q[rest], rank[rest]
            if merged:
                p = np.concatenate(merged)
                before = prv[p]
                post(np.concatenate([before[before >= 0], p[nxt[p] >= 0]]))
        alive = sym >= 0
        count = np.concatenate([[0], np.cumsum(alive)])
        return sym[alive], count[np.concatenate([[0], ends])]

    def encode_known(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The result of :meth:`encode_bytes`; only distinct words that are not known from earlier calls are merged."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(ends):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends])), pa.py_buffer(data)]).dictionary_encode()
        which, words = words.indices.to_numpy(), words.dictionary
        known, ids, upto = self.known or (pa.array([], pa.large_binary()), np.zeros(0, np.int32), np.zeros(1, np.int64))
        at = pc.index_in(words, value_set=known).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = words.take(pa.array(new))
            buf, new_ends = text_buffer(fresh)
            more, offsets = self.encode_bytes(buf, new_ends)
            at[new] = len(known) + np.arange(len(new))
            ids, upto = np.concatenate([ids, more]), np.concatenate([upto, offsets[1:] + upto[-1]])
            room = min(KNOWN_WORDS - len(known), int(np.searchsorted(new_ends, KNOWN_BYTES - known.nbytes, side="right")))
            if room > 0:
                kept = len(known) + min(room, len(new))
                self.known = pa.concat_arrays([known, fresh[: kept - len(known)]]), ids[: upto[kept]].copy(), upto[: kept + 1].copy()
        lens = np.diff(upto)[at][which]
        return ids[ragged(upto[at][which], lens)], np.concatenate([[0], np.cumsum(lens)])

    def decode_ids(self, ids: Iterable[int]) -> str:
        """Text of ids, special tokens included; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


#: Classes of bytes: white space, letters, digits, other ASCII, apostrophe, beyond ASCII.
_SPACE, _LETTER, _DIGIT, _OTHER, _QUOTE, _WIDE = range(6)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[*range(9, 14), *range(0x1C, 0x21)]] = _SPACE
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[ord("'")] = _QUOTE
_CLASS[128:] = _WIDE


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The positions of runs, one run after another."""
    ends = np.cumsum(lens)
    return np.repeat(starts - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0)


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and end offsets of an Arrow string column; null is empty text."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


class ByteLevelEncoder:
    """Texts to ids for byte-level vocabularies without a normaliser.

    Texts are cut before single spaces into pieces; each cut is a pre-token border as long as no other white space
    touches the space. Distinct pieces of a part are pre-tokenised once, distinct words of a worker are merged once, and
    their ids gathered.
    """

    def __init__(self, model: Bpe, part: int = PART):
        self.model, self.part = model, part
        self.pattern = regex.compile(BYTE_LEVEL_PATTERN)
        self.dtype = np.dtype("<u2" if model.size <= 1 << 16 else "<u4")
        self.heads = np.zeros(256, bool)  # bytes that begin a special token
        self.heads[[t.encode()[0] for t in model.added]] = True

    @staticmethod
    def borders(buf: np.ndarray) -> np.ndarray:
        """Positions of single spaces where a text may be cut; too few only make pieces longer."""
        at = np.flatnonzero(buf == 0x20)
        at = at[(at > 0) & (at < len(buf) - 1)]
        before, after = buf[at - 1], buf[at + 1]
        ok = (_CLASS[before] != _SPACE) & (_CLASS[after] != _SPACE)
        # White space beyond ASCII: U+0085 and U+00A0 after a byte C2, and characters that begin with E1 to E3.
        ok &= ~((after == 0xC2) & np.isin(buf[np.minimum(at + 2, len(buf) - 1)], (0x85, 0xA0))) & ~((after >= 0xE1) & (after <= 0xE3))
        two, three = buf[np.maximum(at - 2, 0)], buf[np.maximum(at - 3, 0)]
        ok &= ~((two == 0xC2) & ((before == 0x85) | (before == 0xA0))) & ~((before >= 0x80) & (before < 0xC0) & (three >= 0xE1) & (three <= 0xE3))
        return at[ok]

    def _distinct(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pieces, and where each one's begin and end."""
        starts = ends - np.diff(ends, prepend=0)
        kind = _CLASS[data]
        # U+00C0 to U+023F are letters of two bytes, but for the signs U+00D7 and U+00F7.
        two = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC8))
        kind[two] = kind[two + 1] = _LETTER
        kind[two[(data[two] == 0xC3) & ((data[two + 1] == 0x97) | (data[two + 1] == 0xB7))]] = _WIDE
        lead = starts[(ends - starts > 1) & (data[starts] == 0x20)]
        kind[lead] = kind[lead + 1]  # a leading space belongs to the class of the byte after it
        hard = np.concatenate([[0], np.cumsum((kind == _SPACE) | (kind == _QUOTE) | (kind == _WIDE) | self.heads[data])])
        simple = hard[ends] == hard[starts]
        # Simple pieces: pre-tokens end where the class changes.
        lens = (ends - starts)[simple]
        at = ragged(starts[simple], lens)
        easy, kind, upto = data[at], kind[at], np.cumsum(lens)
        cut = np.zeros(len(easy) + 1, bool)
        cut[1:-1] = kind[1:] != kind[:-1]
        cut[upto] = True
        # Other pieces by the pattern, between special tokens; a special token is an empty word at first.
        words: list[bytes] = []
        marks: list[tuple[int, int]] = []
        until = []
        raw, findall, special = data.tobytes(), self.pattern.findall, self.model.special
        for i, j in zip(starts[~simple].tolist(), ends[~simple].tolist()):
            text = raw[i:j].decode("utf-8", "surrogatepass")
            at = 0
            for m in special.finditer(text) if special else ():
                words += [w.encode("utf-8", "surrogatepass") for w in findall(text[at : m.start()])] + [b""]
                marks.append((len(words) - 1, self.model.added[m[0]]))
                at = m.end()
            words += [w.encode("utf-8", "surrogatepass") for w in findall(text[at:])]
            until.append(len(words))
        word_ends = np.concatenate([np.flatnonzero(cut), len(easy) + np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))]).astype(np.int64)
        n_easy = len(word_ends) - len(words)
        ids, offsets = self.model.encode_known(np.concatenate([easy, np.frombuffer(b"".join(words), np.uint8)]), word_ends)
        if marks:
            which = n_easy + np.array([k for k, _ in marks])
            ids = np.insert(ids, offsets[which], [i for _, i in marks])
            more = np.zeros(len(offsets), np.int64)
            more[which + 1] = 1
            offsets = offsets + np.cumsum(more)
        last = np.zeros(len(ends), np.int64)
        last[simple] = np.cumsum(cut)[upto]
        last[~simple] = n_easy + np.array(until, np.int64)
        first = np.zeros(len(ends), np.int64)
        first[simple] = np.concatenate([[0], last[simple]])[:-1]
        first[~simple] = np.concatenate([[n_easy], last[~simple]])[:-1]
        return ids, offsets[first], offsets[last]

    def _part(self, buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a part, and how many stand before each of the ``ends``, which are borders as well."""
        import pyarrow as pa

        begins = np.zeros(len(buf) + 1, bool)
        begins[0] = begins[self.borders(buf)] = begins[ends] = True
        begins[-1] = False
        starts = np.flatnonzero(begins)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(buf))), pa.py_buffer(buf)]).dictionary_encode()
        which = pieces.indices.to_numpy()
        ids, first, last = self._distinct(*text_buffer(pieces.dictionary))
        lens = (last - first)[which]
        return ids[ragged(first[which], lens)].astype(self.dtype), np.concatenate([[0], np.cumsum(lens)])[np.searchsorted(starts, ends)]

    def encode(self, buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that lie one after another in ``buf`` (UTF-8) up to ``ends``, and where each text's ids end."""
        texts, ends = ends, ends[np.diff(ends, prepend=0) > 0]
        out, upto = [np.zeros(0, self.dtype)], [np.zeros(1, np.int64)]
        at = n = 0
        while at < len(buf):
            stop, size = len(buf), self.part
            while at + size < len(buf):  # a part ends at a border or a text's end
                i, j = np.searchsorted(ends, [at, at + size], side="right")
                if j > i and ends[j - 1] > at + size // 2:
                    stop = int(ends[j - 1])
                    break
                border = self.borders(buf[at : at + size])[-1:]
                if j > i or len(border):
                    stop = max([*ends[i:j][-1:].tolist(), *(at + border).tolist()])
                    break
                size *= 2
            i, j = np.searchsorted(ends, [at, stop], side="right")
            ids, before = self._part(buf[at:stop], ends[i:j] - at)
            out.append(ids)
            upto.append(before + n)
            n += len(ids)
            at = stop
        return np.concatenate(out), np.concatenate(upto)[np.searchsorted(ends, texts, side="right")]

    def encode_batch(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text; null is empty text."""
        import pyarrow as pa

        return self.encode_column(pa.array(texts, pa.large_string()))

    def encode_column(self, column) -> Iterator[np.ndarray]:
        """The ids of each text of an Arrow column."""
        ids, ends = self.encode(*text_buffer(column))
        return (ids[i:j] for i, j in zip([0, *ends.tolist()], ends.tolist()))


def encode(docs: DataFrame, model: Bpe, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(id, ids array<int>)``: every whole text encoded; null and empty texts give no ids.

    Repeated rows stay; other columns are ignored, whatever their names. Texts of any length are encoded in parts of
    ``PART`` bytes; beside its text and ids a long one takes no more memory than a part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary

    def run(batches):
        import pyarrow as pa

        enc = ByteLevelEncoder(shared.value)
        for b in batches:
            ids, ends = enc.encode(*text_buffer(b.column(1)))
            ends = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int32)))], ["id", "ids"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, ids array<int>")


def decode(rows: DataFrame, model: Bpe, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """Rows ``(id, text)``: ids decoded, special tokens included; null ids give null text."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            got = [None if ids is None else shared.value.decode_ids(ids) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.string())], ["id", "text"])

    return rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, text string")


def round_trip(docs: DataFrame, model: Bpe, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text; digests of both.

    ``doc_id, n_tokens, ids_sha256, decoded_sha256``. Null text counts as empty: no tokens, digests of nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        enc = ByteLevelEncoder(shared.value)
        sha, decimal, bytes_of = hashlib.sha256, enc.model.decimal.__getitem__, enc.model.bytes_of.__getitem__
        for b in batches:
            n, a, d = [], [], []
            for ids in enc.encode_column(b.column(1)):
                ids = ids.tolist()
                n.append(len(ids))
                a.append(sha(",".join(map(decimal, ids)).encode()).hexdigest())
                d.append(sha(b"".join(map(bytes_of, ids)).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        give_back()

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
