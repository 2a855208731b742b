"""Byte-level BPE with forced boundaries.

A byte pair that is inside no token of the vocabulary can never be merged over, so the place between its bytes is a
certain cut. A text is split by the tokenizer's pattern and each word at its forced cuts; the fragments are encoded on their
own and the ids put together. Words and fragments repeat, so each Python worker keeps what it has encoded.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.llm.common import give_back, worker_state

#: Fixed values of byte-level tokenizers: the pattern that splits a text, with Unicode's White_Space spelled out.
_WHITE = r"\t-\r \x85\xa0  -     　"
PATTERN = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
)
_OTHER_WHITE = re.compile(rf"[{_WHITE}]".replace(" ", "").replace(r"\t-\r", r"\t\x0b-\r"))
#: Words and fragments that a worker keeps encoded before it starts anew; it bounds memory, not results.
STORED_RUNS = 400_000
#: Bytes of text that are handled together in a task.
PART_BYTES = 1_000_000
#: Fragments up to this many bytes are merged in a list, longer ones with a heap.
SHORT = 96
_NEVER = 1 << 30


def _letters_of_bytes() -> list[str]:
    """The letter that stands for each byte in vocabulary files: printable bytes for themselves, others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in printable}, 256
    for b in range(256):
        if b not in letters:
            letters[b], spare = chr(spare), spare + 1
    return [letters[b] for b in range(256)]


class _PairTable:
    """Ranks of token pairs for whole arrays: a hash table with open addressing."""

    BITS = 18

    def __init__(self, rank: dict[tuple[int, int], int], merged: list[int]):
        self.merged = np.array(merged, np.int32)
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.values = np.full(1 << self.BITS, _NEVER, np.int32)
        pairs = np.array(list(rank), np.int64).reshape(-1, 2)
        keys, values = pairs[:, 0] << 32 | pairs[:, 1], np.fromiter(rank.values(), np.int32, len(rank))
        slot, self.probes = self._slot(keys), 0
        while len(keys):  # first comers take a slot, the others try the next
            self.probes += 1
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            taken = self.keys[slot] == keys
            self.values[slot[taken]] = values[taken]
            keys, values, slot = keys[~taken], values[~taken], (slot[~taken] + 1) & ((1 << self.BITS) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        shape = left.shape
        keys = (left.astype(np.int64) << 32 | right).ravel()
        keys[(right < 0).ravel() | (left < 0).ravel()] = -2
        out, slot, open_ = np.full(len(keys), _NEVER, np.int32), self._slot(keys), np.flatnonzero(keys >= 0)
        slot = slot[open_]
        for _ in range(self.probes):
            here = self.keys[slot]
            hit = here == keys[open_]
            out[open_[hit]] = self.values[slot[hit]]
            on = ~hit & (here >= 0)
            open_, slot = open_[on], (slot[on] + 1) & ((1 << self.BITS) - 1)
            if not len(open_):
                break
        return out.reshape(shape)


class ByteBpe:
    """Encoder and decoder of one vocabulary file (its text as JSON)."""

    def __init__(self, spec: str):
        import regex

        file = json.loads(spec)
        model = file["model"]
        if model.get("type", "BPE") != "BPE" or (file.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError("a byte-level BPE file is needed")
        if file["pre_tokenizer"].get("add_prefix_space") or file.get("normalizer") or model.get("ignore_merges"):
            raise ValueError("normalizers, prefix spaces and ignored merges are not supported")
        byte_of = {c: b for b, c in enumerate(_letters_of_bytes())}
        vocab = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        self.piece = [b""] * (1 + max([*vocab.values(), *self.added.values()]))
        for token, i in vocab.items():
            self.piece[i] = token
        for token, i in self.added.items():
            self.piece[i] = token.encode()
        self.byte_id = [vocab[bytes([b])] for b in range(256)]
        self.rank, self.merged = {}, []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            left, right = (bytes(byte_of[c] for c in side) for side in (left, right))
            self.rank[vocab[left], vocab[right]] = rank
            self.merged.append(vocab[left + right])
        inside = bytearray(65536)
        for token in vocab:
            for a, b in zip(token, token[1:]):
                inside[a << 8 | b] = 1
        #: Pairs that are inside some token, as a table over both bytes.
        self.inside = np.frombuffer(bytes(inside), np.uint8)
        self._byte_ids = np.array(self.byte_id, np.int32)
        self.words = regex.compile(PATTERN).findall
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        self.runs: dict[str, bytes] = {}
        self.fragments: dict[bytes, bytes] = {}
        self._pairs = _PairTable(self.rank, self.merged)

    def cuts(self, words: list[bytes]) -> list[list[bytes]]:
        """Each word, split wherever a pair is inside no token."""
        if not words:
            return []
        joined, lengths = b"".join(words), np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(joined, np.uint8).astype(np.int32)
        forced = np.ones(len(flat) + 1, bool)
        forced[1:-1] = self.inside[flat[:-1] << 8 | flat[1:]] == 0
        ends = np.cumsum(lengths)
        forced[ends] = True
        places = np.flatnonzero(forced).tolist()
        fragments = [joined[i:j] for i, j in zip(places, places[1:])]
        upto = np.cumsum(forced[1:])[ends - 1].tolist()
        return [fragments[i:j] for i, j in zip([0, *upto], upto)]

    def _merge_short(self, fragments: list[bytes]) -> list[bytes]:
        """Merge many fragments of at most SHORT bytes at once: in every round each takes its best pair, the leftmost of equals."""
        count, width = len(fragments), max(map(len, fragments))
        length = np.fromiter(map(len, fragments), np.int64, count)
        ids = np.full((count, width + 1), -1, np.int32)
        ids[:, :width][np.arange(width) < length[:, None]] = self._byte_ids[np.frombuffer(b"".join(fragments), np.uint8)]
        ranks = self._pairs.ranks(ids[:, :-1], ids[:, 1:])
        live, columns = np.arange(count), np.arange(width)
        while len(live):
            at = ranks[live].argmin(axis=1)
            best = ranks[live, at]
            found = best < _NEVER
            live, at, best = live[found], at[found], best[found]
            if not len(live):
                break
            # Close the gap behind the merged pair, then look up the pairs on both sides of it.
            source = columns + (columns > at[:, None])
            source_ids = np.take_along_axis(ids[live], np.minimum(source, width), axis=1)
            source_ids[np.arange(len(live)), at] = self._pairs.merged[best]
            ids[live, :width] = source_ids
            # Ranks of pairs right of the merged one move along; the last place is free.
            moved = np.take_along_axis(ranks[live], np.minimum(source, width - 1), axis=1)
            moved[:, -1] = _NEVER
            ranks[live] = moved
            ranks[live, at] = self._pairs.ranks(ids[live, at], ids[live, at + 1])
            left = at > 0
            rows, at = live[left], at[left]
            ranks[rows, at - 1] = self._pairs.ranks(ids[rows, at - 1], ids[rows, at])
            length[live] -= 1
        packed = ids[:, :width].astype("<u4").tobytes()
        return [packed[i : i + 4 * n] for i, n in zip(range(0, 4 * width * count, 4 * width), length.tolist())]

    def _learn_fragments(self, fragments: set[bytes]) -> None:
        if len(self.fragments) + len(fragments) > STORED_RUNS:
            self.fragments.clear()
        classes: dict[int, list[bytes]] = {}
        for fragment in fragments:
            if len(fragment) > SHORT:
                self.fragments[fragment] = self._merge_long([self.byte_id[b] for b in fragment])
            else:
                classes.setdefault(((len(fragment) - 1) >> 2).bit_length(), []).append(fragment)
        for same in classes.values():
            for i in range(0, len(same), 20_000):
                part = same[i : i + 20_000]
                self.fragments.update(zip(part, self._merge_short(part)))

    def _merge_long(self, ids: list[int]) -> bytes:
        """The same merges in the same order, found with a heap: (rank, place) of pairs that may be out of date."""
        get, n = self.rank.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(get((ids[i], ids[i + 1])), i) for i in range(n - 1) if (ids[i], ids[i + 1]) in self.rank]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or get((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j] = self.merged[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (found := get((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (found, i))
            if (h := before[i]) >= 0 and (found := get((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (found, h))
        return array("I", [i for i in ids if i >= 0]).tobytes()

    def _words(self, run: str) -> list[str]:
        """The words of the pattern in a run; letters with one full stop or comma need no search."""
        body = run[1:] if run[:1] == " " else run
        if body.isalpha():
            return [run]
        if body[:-1].isalpha() and body[-1] in ".,":
            return [run[:-1], run[-1]]
        return self.words(run)

    def _encode_runs(self, runs: list[str]) -> list[bytes]:
        """Ids of runs that stand for themselves."""
        words = [self._words(run) for run in runs]
        distinct = list({w for of_run in words for w in of_run})
        parts = dict(zip(distinct, self.cuts([w.encode() for w in distinct])))
        new = {f for of_word in parts.values() for f in of_word}
        new.difference_update(self.fragments)
        if len(new) > STORED_RUNS // 2 and len(runs) > 1:
            half = len(runs) // 2
            return self._encode_runs(runs[:half]) + self._encode_runs(runs[half:])
        self._learn_fragments(new | {f for of_word in parts.values() for f in of_word} if len(self.fragments) + len(new) > STORED_RUNS else new)
        get = self.fragments.__getitem__
        return [b"".join([get(f) for word in of_run for f in parts[word]]) for of_run in words]

    def _special(self, text: str) -> bool:
        """Whether blanks or added tokens ask for more than a split at single spaces."""
        return "  " in text or text.endswith(" ") or bool(_OTHER_WHITE.search(text)) or any(t in text for t in self.added)

    def _sections(self, text: str) -> bytes:
        sections = self.split_added(text) if self.added else [text]
        plain = iter(self._encode_runs(sections[::2]))
        return b"".join(array("I", [self.added[s]]).tobytes() if i % 2 else next(plain) for i, s in enumerate(sections))

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text begins (one more entry than texts).

        One space between words belongs to the word behind it, whatever stands around, so texts are split at spaces and
        each distinct word is encoded once. The first word of a text, and a text with unusual blanks or added tokens
        as a whole, get an entry of their own.
        """
        strings = texts.fill_null("").to_pylist()
        special = [self._special(t) for t in strings]
        lists = pc.split_pattern(pa.array(["" if s else t for s, t in zip(special, strings)], pa.large_string()), " ")
        words = lists.flatten().dictionary_encode()
        codes, known = words.indices.to_numpy().astype(np.int64), words.dictionary.to_pylist()
        new = [w for w in known if w not in self.runs]
        if len(self.runs) + len(new) > STORED_RUNS:
            self.runs.clear()
            new = known
        self.runs.update(zip(new, self._encode_runs([" " + w for w in new])))
        heads = iter(self._encode_runs([t.partition(" ")[0] for s, t in zip(special, strings) if not s]))
        entries = [self.runs[w] for w in known]
        entries += [self._sections(t) if s else next(heads) for s, t in zip(special, strings)]
        begins = lists.offsets.to_numpy()
        codes[begins[:-1]] = len(known) + np.arange(len(strings))
        return _gather(entries, 4, np.uint32, codes, begins)

    def encode(self, text: str | None) -> bytes:
        return self.encode_batch(pa.array([text], pa.string()))[0].tobytes()

    def decode_batch(self, ids: np.ndarray, begins: np.ndarray) -> list[str]:
        """Texts of ids as :meth:`encode_batch` gives them; bytes that are no UTF-8 become replacement characters."""
        data, places = _gather(self.piece, 1, np.uint8, ids, begins)
        data, places = data.tobytes(), places.tolist()
        return [data[i:j].decode("utf-8", "replace") for i, j in zip(places, places[1:])]


def _gather(entries: list[bytes], width: int, dtype, codes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Put together the entries that ``codes`` name; ``begins`` (places in codes) become places in the result."""
    flat = np.frombuffer(b"".join(entries), dtype)
    length = np.fromiter(map(len, entries), np.int64, len(entries)) // width
    start = np.cumsum(length) - length
    own = length[codes]
    upto = np.concatenate([[0], np.cumsum(own)])
    return flat[np.repeat(start[codes] - upto[:-1], own) + np.arange(upto[-1])], upto[begins]


def _loaded(spec: str) -> ByteBpe:
    state = worker_state("bpe")
    key = hash(spec)
    if key not in state:
        state.clear()
        state[key] = ByteBpe(spec)
    return state[key]


def _spec_of(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def _slices(batch: pa.Array) -> Iterator[pa.Array]:
    """Parts of an array of about PART_BYTES bytes."""
    size = pc.cumulative_sum(pc.binary_length(batch).cast("int64").fill_null(0)).to_numpy(zero_copy_only=False)
    cuts = [0, *(1 + np.flatnonzero(np.diff(size // PART_BYTES))).tolist(), len(batch)]
    return (batch.slice(i, j - i) for i, j in zip(cuts, cuts[1:]) if j > i)


def _packed(ids: np.ndarray, begins: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(begins) - 1, [None, pa.py_buffer((4 * begins).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))]
    )


def encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", n: str = "n_tokens", decoded: str | None = None) -> DataFrame:
    """Add ``ids`` (binary: little-endian unsigned 32-bit token ids) and ``n`` (their number) to every row.

    With ``decoded``, a column of that name gets the ids decoded again, in the same pass. ``tokenizer`` is the path of a
    vocabulary file; it is read on the driver and sent once to each executor (its size is that of the file, some MB).
    Null and empty texts have no ids and decode to an empty text. Columns of those names are replaced; repeated rows and
    other columns stay as they are; an empty table gives an empty table.
    """
    spec = df.sparkSession.sparkContext.broadcast(_spec_of(tokenizer))
    again = decoded is not None

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _loaded(spec.value)
        for batch in texts:
            parts = []
            for part in _slices(batch):
                numbers, begins = coder.encode_batch(part)
                columns = [_packed(numbers, begins)]
                if again:
                    columns.append(pa.array(coder.decode_batch(numbers, begins), pa.string()))
                parts.append(pa.StructArray.from_arrays(columns, ["ids", "decoded"][: len(columns)]))
            yield pa.concat_arrays(parts)
        give_back()

    coded = F.arrow_udf(run, "ids binary" + ", decoded string" * again)(F.col(text))
    kept = [c for c in df.columns if c not in (ids, n, decoded)]
    out = df.select(*kept, coded.alias("_coded")).withColumn(ids, F.col("_coded.ids"))
    if again:
        out = out.withColumn(decoded, F.col("_coded.decoded"))
    return out.withColumn(n, (F.octet_length(ids) / 4).cast("long")).drop("_coded")


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add ``text``, what the packed ids stand for; null ids give a null text. Otherwise as :func:`encode`."""
    spec = df.sparkSession.sparkContext.broadcast(_spec_of(tokenizer))

    def run(packed: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _loaded(spec.value)
        for batch in packed:
            texts = []
            for part in _slices(batch):
                sizes = pc.binary_length(part).fill_null(0).to_numpy(zero_copy_only=False)
                numbers = np.frombuffer(b"".join(part.fill_null(b"").to_pylist()), "<u4")
                texts += coder.decode_batch(numbers, np.concatenate([[0], np.cumsum(sizes // 4)]))
            yield pc.if_else(batch.is_valid(), pa.array(texts, pa.string()), pa.scalar(None, pa.string()))

    return df.withColumn(text, F.arrow_udf(run, "string")(F.col(ids)))
