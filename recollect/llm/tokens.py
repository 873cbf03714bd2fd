"""Token-id files compressed by Re-Pair grammars.

Documents are dealt by ranges of their ids and tokenised in order. About a million ids make a shard; a shard never
cuts a document. In a shard the most frequent pairs of neighbouring symbols become nonterminals until no pair comes
``LEAST_PAIRS`` times. A shard's row in the file keeps the rules, the expansion length of every nonterminal, the
remaining symbols and, for every 1024th symbol, the number of ids before it; so one document is decoded from the
symbols that cover it, without the rest of the shard (``lookup``). Rows reach the workers in small batches, as each
holds a shard and a memo besides.

File layout, format 2: a Parquet folder with a row per shard: range, shard (order within it), n_ids, ids (document
ids), lens (ids of each document, end included), first (number of terminals), rules (pairs of u32), lengths (u32),
width and n_symbols, symbols (width bits each, highest first), marks (u64). Little-endian but for the symbols. Global
offsets follow from n_ids.

Defined results: a null text counts as empty; a null id comes first; rows with equal ids stand in the order of their
texts; an empty document is the end id alone; a text of any length is one document; an empty table makes an empty file;
other columns are not read.
"""

from __future__ import annotations

import gc
import os
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.llm.common import scratch_path, shuffles_dropped, small_batches, small_side
from recollect.llm.ordered import dealt

SHARD_IDS, LEAST_PAIRS, MARK = 1 << 20, 8, 1024
MEMO_PIECES, SEEN, TOGETHER, BROADCAST_SHARDS = 400_000, 1 << 22, 1 << 20, 1_000_000


#: Signs that stand for , . and newline where a text is cut, so that a word and the stop after it are two pieces.
_MARKS = {",": "\x01", ".": "\x02", "\n": "\x03"}
_SIGNS = {v: k for k, v in _MARKS.items()}
#: Beginnings of pieces that have no space before them; the NUL stands for the text's own beginning.
_LEADS = ("\0", *_SIGNS)
#: Signs after a word that are one token class, whatever follows.
_CLOSING = "!?;:)]}%&$#*"
#: What a piece is like at its borders: ends in a sign or a space, begins with a stop, a newline or the text, never cut here.
_ENDS_SIGN, _ENDS_SPACE, _BEGINS_STOP, _BEGINS_LINE, _NEVER, _BEGINS_TEXT = 1, 2, 4, 8, 16, 32


class Encoder:
    """A byte-level BPE tokenizer with a memo of pieces.

    Such tokenizers cut a text at spaces before other characters, between letters and signs, and at newlines. Texts are
    cut there first: at single spaces, and before each comma, stop and newline. The ids of the pieces in a row are the
    text's, unless signs or spaces would meet across a cut; texts where they do are encoded whole. The texts given at a
    time are cut as one column of pieces, of which each different one is looked up or learned once. A piece of letters is
    one word for the tokenizer's model, which is called directly. Tokenizers of other kinds, or that fail a comparison on
    a sample, are used on whole texts only."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.odd = ["\0", *_SIGNS, *(t.content for t in self.tokenizer.get_added_tokens_decoder().values())]
        # Byte-level tokenizers write each byte as a letter; the pre-tokenizer shows which.
        show = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        samples = [chr(i) for i in range(128)] + [chr(i) for i in (*range(128, 0x800), 0x800, *range(0x1000, 0xD000, 0x1000), 0xE000, 0xF000, *range(0x10000, 0x110000, 0x40000))]
        self.letters = {ord(b): show(c)[0][0][k] for c in samples for k, b in enumerate(c.encode().decode("latin-1"))}
        self.split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.leads = {"\0": []} | {mark: self._ids(sign) for mark, sign in _SIGNS.items()}
        self.signs: dict[str, list[int]] = {}
        sample = "A b. c's 12,5 x\ny\t?! z Straße, naïve... où.\n\nEnd"
        self.clear()
        self.by_piece = self.tokenizer.normalizer is None and all(self.encode(t).tolist() == self._ids(t) for t in (sample, sample.replace("...", ".").replace("\n\n", "\n"), "a b, c.\nd"))
        self.clear()

    by_piece = True

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.flat, self.start, self.length, self.border = array("I"), array("q"), array("i"), bytearray()
        self.seen = bytearray(SEEN)

    def _border(self, piece: str, text: str) -> int:
        last = text[-1:]
        out = (_ENDS_SPACE if last.isspace() else 0) | (_ENDS_SIGN if last and not last.isalnum() and not last.isspace() else 0)
        out |= _BEGINS_STOP if piece[:1] in "\x01\x02" else _BEGINS_LINE if piece[:1] == "\x03" else 0
        return out | (_NEVER if not text or text[0].isspace() and piece[0] not in "\x03\0" else 0)

    def _word(self, word: str, space: str = "") -> list[int]:
        return [t.id for t in self.model.tokenize(space + (word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)))]

    def _other(self, piece: str) -> tuple[list[int], int]:
        """Ids and border of a piece that is not of letters only."""
        if piece == "\0":
            return [], 0
        first, rest = piece[:1], piece[1:]
        core = piece.rstrip(_CLOSING)
        if first in _LEADS and rest.isalpha():
            return self.leads[first] + self._word(rest), self._border(piece, rest)
        if core.isalpha():
            signs = piece[len(core) :]
            if signs not in self.signs:
                self.signs[signs] = self._ids(signs)
            return self._word(core, self.letters[32]) + self.signs[signs], _ENDS_SIGN
        text = _SIGNS[first] + rest if first in _SIGNS else rest if first == "\0" else piece
        return [t.id for word, _ in self.split(text if first in _LEADS else " " + text) for t in self.model.tokenize(word)], self._border(piece or " ", text)

    def _learn(self, pieces: list[bytes]) -> None:
        """Adds pieces, each with the space after it."""
        cores, space = [piece[:-1].decode() for piece in pieces], self.letters[32]
        found = [self._word(core, space) if core.isalpha() else None for core in cores]
        border = bytearray(len(cores))
        for i, ids in enumerate(found):
            if ids is None:
                core = cores[i]
                found[i], border[i] = self._other(core)
                border[i] |= _BEGINS_TEXT if core[:1] == "\0" else 0
        lengths = np.fromiter(map(len, found), np.int32, len(found))
        self.start.frombytes((len(self.flat) + np.cumsum(lengths, dtype=np.int64) - lengths).tobytes())
        self.length.frombytes(lengths.tobytes())
        self.border.extend(border)
        self.flat.extend(chain.from_iterable(found))

    def _numbers(self, pieces: list[bytes]) -> np.ndarray:
        """Numbers of pieces, all different. The memo takes a piece at first sight until it is half full, then when it is
        met again and there is room; others are learned for these texts only."""
        at = np.fromiter(map(self.number.get, pieces, repeat(-1)), np.int64, len(pieces))
        lacking = np.flatnonzero(at < 0)
        self.kept = (len(self.start), len(self.flat))
        if len(lacking):
            seen, keep, once, room = self.seen, [], [], MEMO_PIECES - len(self.number)
            for i in lacking.tolist():
                k = hash(pieces[i]) % SEEN
                if room > len(keep) and (seen[k] or room - len(keep) > MEMO_PIECES // 2):
                    keep.append(i)
                else:
                    seen[k] = 1
                    once.append(i)
            base = len(self.start)
            at[keep + once] = np.arange(base, base + len(lacking))
            if keep:
                self._learn([pieces[i] for i in keep])
                self.number.update(zip([pieces[i] for i in keep], range(base, base + len(keep)), strict=True))
                self.kept = (len(self.start), len(self.flat))
            self._learn([pieces[i] for i in once])
        return at

    def _forget(self) -> None:
        if self.kept[0] < len(self.start):
            del self.start[self.kept[0] :], self.length[self.kept[0] :], self.border[self.kept[0] :], self.flat[self.kept[1] :]

    kept = (0, 0)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts; the pieces of all of them are looked up at once."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        owner = []
        for i, text in enumerate(texts):
            if text and self.by_piece and not any(m in text for m in self.odd):
                owner.append(i)
            elif text:
                out[i] = np.array(self._ids(text), np.uint32)
        if not owner:
            return out
        pieces, which = self._pieces([texts[i] for i in owner])
        number = self._numbers(pieces)
        border = np.frombuffer(self.border, np.uint8)[number][which]
        last = np.append(np.flatnonzero(border & _BEGINS_TEXT)[1:], len(which)) - 1
        # A sign meets a stop, or a space a newline: the bits of what begins, shifted, are those of what ends.
        bad = np.concatenate((border[:-1] & (border[1:] >> 2) & 3, [0])) | (border & _NEVER)
        bad[last] = border[last] & _NEVER
        n = np.frombuffer(self.length, np.int32)[number][which]
        ends = np.cumsum(n, dtype=np.int64)
        ids = np.frombuffer(self.flat, np.uint32)[np.repeat(np.frombuffer(self.start, np.int64)[number][which] - (ends - n), n) + np.arange(ends[-1])]
        for i, own in zip(owner, np.split(ids, ends[last[:-1]]), strict=True):
            out[i] = own
        if bad.any():
            for k in np.unique(np.searchsorted(last, np.flatnonzero(bad))).tolist():
                out[owner[k]] = np.array(self._ids(texts[owner[k]]), np.uint32)
        self._forget()
        return out

    def _pieces(self, texts: list[str]) -> tuple[list[bytes], np.ndarray]:
        """The different pieces of texts in UTF-8, each with the space after it, and which of them stand one after the other. The
        first piece of a text begins with a NUL."""
        whole = "\0" + " \0".join(texts) + " "
        for sign, mark in _MARKS.items():
            whole = whole.replace(sign, " " + mark)
        data = whole.encode()
        bounds = np.concatenate(([0], np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1))
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        _, ends, own = coded.dictionary.buffers()
        ends, own = np.frombuffer(ends, np.int64, len(coded.dictionary) + 1).tolist(), own.to_pybytes()
        return [own[a:z] for a, z in zip(ends, ends[1:], strict=False)], np.frombuffer(coded.indices.buffers()[1], np.int32, len(coded))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process, as its memo serves all tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Grammar:
    """rules[k] = the two symbols of nonterminal first + k; lengths[k] = ids it stands for."""

    def __init__(self, first: int, rules: np.ndarray, lengths: np.ndarray, symbols: np.ndarray):
        self.first, self.rules, self.lengths, self.symbols, self.spelt = first, rules, lengths, symbols, None

    def weights(self, symbols: np.ndarray) -> np.ndarray:
        """Ids that each symbol stands for."""
        n = np.ones(len(symbols), np.int64)
        deep = symbols >= self.first
        n[deep] = self.lengths[symbols[deep] - self.first]
        return n

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for, from those of all nonterminals, which are spelt out once."""
        if self.spelt is None:
            flat, start = [np.arange(self.first, dtype=np.uint32)], np.concatenate((np.arange(self.first), self.first + np.cumsum(self.lengths) - self.lengths))
            own = np.arange(self.first, self.first + len(self.rules), dtype=np.uint32)
            while (deep := own >= self.first).any():
                at = np.cumsum(1 + deep) - 1 - deep
                out = np.empty(len(own) + int(deep.sum()), np.uint32)
                out[at] = own
                pairs = self.rules[own[deep] - self.first]
                out[at[deep]], out[at[deep] + 1] = pairs[:, 0], pairs[:, 1]
                own = out
            self.spelt = np.concatenate([*flat, own]), start
        flat, start = self.spelt
        n = self.weights(symbols)
        ends = np.cumsum(n)
        return flat[np.repeat(start[symbols] - (ends - n), n) + np.arange(int(ends[-1]))] if len(n) else symbols


def _frequent_pairs(left: np.ndarray, right: np.ndarray, at: np.ndarray, bits: int, room: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of symbols, left and right at the places at, that come at least least times: sorted, as one number each; how
    often they come; and their places, pair by pair. Symbols have so many bits, places fit in room bits."""
    key = left.astype(np.uint64)
    key <<= np.uint64(bits)
    key |= right
    packed = 2 * bits + room <= 64
    if packed:
        key <<= np.uint64(room)
        key |= at.view(np.uint64)
        key.sort()
        place, key = key, key >> np.uint64(room)
    else:
        order = np.argsort(key, kind="stable")
        place, key = at[order], key[order]
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))[: len(key)]
    count = np.diff(np.append(start, len(key)))
    often = count >= least
    place = place[np.flatnonzero(np.repeat(often, count))]
    if packed:
        place &= np.uint64((1 << room) - 1)
    return key[start[often]], count[often], place.view(np.int64)


def repair(ids: np.ndarray, first: int, least: int = LEAST_PAIRS) -> Grammar:
    """A grammar of ids, all smaller than first, in which no pair of symbols comes least times any more.

    Each round counts all pairs exactly (in a run of one symbol every second place counts) and ranks those that come
    least times or more by count, ties by the symbols. A place is replaced if its pair ranks above those of both
    neighbouring places, so the top pair is replaced wherever it stands, like in one step of Re-Pair, and with it all
    pairs that it does not touch. A pair that keeps fewer than least places waits for a later round. From the second
    round on only pairs that came least times before, or hold a new symbol, are counted: no other can have gained."""
    seq, made, lengths = ids.astype(np.uint32), [np.zeros((0, 2), np.uint32)], np.zeros(0, np.int64)
    live = np.ones(max(0, len(seq) - 1), bool)
    while len(seq) >= 2 * least:
        base = first + len(lengths)
        same = np.flatnonzero((seq[:-1] == seq[1:]) & live)
        new_run = np.concatenate(([True], np.diff(same) != 1))
        overlap = same[(same - same[new_run][np.cumsum(new_run) - 1]) % 2 == 1] if len(same) else same
        live[overlap] = False
        at, bits = np.flatnonzero(live), base.bit_length()
        pairs, n, place = _frequent_pairs(seq[at], seq[at + 1], at, bits, len(seq).bit_length(), least)
        if not len(pairs):
            break
        order = np.lexsort((pairs, -n))[::-1]
        rank = np.empty(len(n), np.int32)
        rank[order] = np.arange(1, len(n) + 1)
        ranks = np.zeros(len(seq) + 1, np.int32)
        ranks[place + 1] = np.repeat(rank, n)
        mine = ranks[1:-1]
        put = np.flatnonzero((mine > ranks[:-2]) & (mine > ranks[2:]))
        which = order[mine[put] - 1]
        used = np.bincount(which, minlength=len(n)) >= least
        chosen = np.flatnonzero(used[which])
        put = put[chosen]
        seq[put] = (base + np.cumsum(used) - 1)[which[chosen]]
        # 1: a place whose pair was often, or within a run; 2: a new symbol. The places after new symbols go.
        state, keep = np.append(mine > 0, False).view(np.uint8), np.ones(len(seq), bool)
        state[overlap], state[put], keep[put + 1] = 1, 2, False
        kept = np.flatnonzero(keep)
        seq, state = seq[kept], state[kept]
        live = (state[:-1] > 0) | (state[1:] == 2)
        rules = np.stack([pairs[used] >> np.uint64(bits), pairs[used] & np.uint64((1 << bits) - 1)], axis=1).astype(np.uint32)
        inner = rules.astype(np.int64) - first
        lengths = np.concatenate((lengths, np.where(inner < 0, 1, lengths[np.maximum(inner, 0)] if len(lengths) else 1).sum(axis=1)))
        made.append(rules)
    return Grammar(first, np.concatenate(made), lengths, seq)


def packed_bits(symbols: np.ndarray, width: int) -> bytes:
    """symbols as numbers of width bits, one after the other, highest bit first."""
    bits = np.unpackbits(symbols.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(bits[:, 32 - width :]).tobytes()


def unpacked_bits(data: bytes | memoryview, width: int, n: int) -> np.ndarray:
    own = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(5, np.uint8)))
    bit = np.arange(n) * width
    at, value = bit >> 3, np.zeros(n, np.uint64)
    for k in range((width + 14) // 8):
        value = (value << np.uint64(8)) | own[at + k]
    drop = 8 * ((width + 14) // 8) - width - (bit & 7)
    return ((value >> drop.astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)


FIELDS = "range int, shard int, n_ids long, ids array<long>, lens array<long>, first long, rules binary, lengths binary, width int, n_symbols long, symbols binary, marks binary"
_SCHEMA = pa.schema([("range", pa.int32()), ("shard", pa.int32()), ("n_ids", pa.int64()), ("ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int64())), ("first", pa.int64()), ("rules", pa.binary()), ("lengths", pa.binary()), ("width", pa.int32()), ("n_symbols", pa.int64()), ("symbols", pa.binary()), ("marks", pa.binary())])


def pack(place: int, shard: int, keys: list, lens: list[int], ids: np.ndarray, first: int) -> dict:
    made = repair(ids, first)
    width = max(1, int(made.symbols.max()).bit_length()) if len(made.symbols) else 1
    before = np.concatenate(([0], np.cumsum(made.weights(made.symbols))))[:-1:MARK] if len(made.symbols) else np.zeros(0)
    return {
        "range": place, "shard": shard, "n_ids": len(ids), "ids": keys, "lens": lens, "first": first, "rules": made.rules.astype("<u4").tobytes(), "lengths": made.lengths.astype("<u4").tobytes(),
        "width": width, "n_symbols": len(made.symbols), "symbols": packed_bits(made.symbols, width), "marks": before.astype("<u8").tobytes(),
    }


class Shard:
    """Reads a row of the file."""

    def __init__(self, row: dict):
        self.data, self.width, self.n_symbols = memoryview(row["symbols"]), row["width"], row["n_symbols"]
        self.grammar = Grammar(row["first"], np.frombuffer(row["rules"], "<u4").reshape(-1, 2), np.frombuffer(row["lengths"], "<u4").astype(np.int64), np.zeros(0, np.uint32))
        self.ids, self.marks = row["ids"], np.frombuffer(row["marks"], "<u8").astype(np.int64)
        self.ends = np.cumsum(np.array(row["lens"], np.int64))

    def symbols(self, a: int, z: int) -> np.ndarray:
        """From mark a up to mark z."""
        n = min(z * MARK, self.n_symbols) - a * MARK
        start = a * MARK * self.width // 8
        return unpacked_bits(self.data[start : start - (-n * self.width // 8)], self.width, n)

    def all(self) -> np.ndarray:
        return self.grammar.expand(self.symbols(0, len(self.marks)))

    def document(self, k: int) -> np.ndarray:
        """The ids of the shard's k-th document, from the symbols around them only."""
        start, end = int(self.ends[k - 1]) if k else 0, int(self.ends[k])
        a, z = int(np.searchsorted(self.marks, start, "right")) - 1, int(np.searchsorted(self.marks, end, "left"))
        part = self.symbols(a, z)
        before = int(self.marks[a])
        ends = before + np.cumsum(self.grammar.weights(part))
        i, j = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, end, "left")) + 1
        skip = start - (int(ends[i - 1]) if i else before)
        return self.grammar.expand(part[i:j])[skip : skip + end - start]


def _together(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """The texts of column in runs of some ``TOGETHER`` characters, each with the place where it begins."""
    start, texts, size = 0, [], 0
    for i in range(len(column)):
        texts.append(column[i].as_py() or "")
        size += len(texts[-1])
        if size >= TOGETHER:
            yield start, texts
            start, texts, size = i + 1, [], 0
    if texts:
        yield start, texts


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, shard_ids: int = SHARD_IDS, rows_each: int = 20_000) -> None:
    """Tokenises docs and writes the file at path. tokenizer: the place of a tokenizers JSON that every executor has."""

    def run(batches):
        gc.set_threshold(100_000)  # short-lived lists of tokens come by the million
        code = encoder(tokenizer)
        first = max(code.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        place, shard, keys, lens, parts, n = None, 0, [], [], [], 0
        for batch in batches:
            for start, texts in _together(batch.column(3)):
                some = batch.slice(start, len(texts))
                coded = code.encode_all(texts)
                for at, key, own in zip(some.column(0).to_pylist(), some.column(2).to_pylist(), coded, strict=True):
                    if at != place or n >= shard_ids:
                        if keys:
                            yield pa.RecordBatch.from_pylist([pack(place, shard, keys, lens, np.concatenate(parts), first)], _SCHEMA)
                        shard, place, keys, lens, parts, n = (shard + 1 if at == place else 0), at, [], [], [], 0
                    ids = np.append(own, np.uint32(end_id))
                    keys.append(key)
                    lens.append(len(ids))
                    parts.append(ids)
                    n += len(ids)
        if keys:
            yield pa.RecordBatch.from_pylist([pack(place, shard, keys, lens, np.concatenate(parts), first)], _SCHEMA)

    with shuffles_dropped(docs.sparkSession), small_batches(docs.sparkSession):
        dealt(docs, id_col, text_col, rows_each).mapInArrow(run, FIELDS).write.option("compression", "snappy").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The file's rows with base, the number of ids before the shard: sums by range first, then within each."""
    shards = spark.read.parquet(path)
    sizes = shards.groupBy("range").agg(F.sum("n_ids").alias("words"))
    ahead = sizes.select(F.col("range").alias("r"), F.coalesce(F.sum("words").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = shards.select(F.col("range").alias("r"), F.col("shard").alias("s"), F.coalesce(F.sum("n_ids").over(W.partitionBy("range").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("inside"))
    base = inside.join(ahead, "r").select("r", "s", (F.col("before") + F.col("inside")).alias("base"))
    return shards.join(small_side(base, BROADCAST_SHARDS), (F.col("range") == F.col("r")) & (F.col("shard") == F.col("s"))).drop("r", "s")


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32 and, with_ids, tokens): each document, decoded from the file."""
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("tokens", pa.list_(pa.int64()))] if with_ids else [])])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                shard = Shard(row)
                ids = shard.all()
                out, start = [], 0
                for key, end in zip(shard.ids, shard.ends.tolist(), strict=True):
                    own = np.ascontiguousarray(ids[start:end].astype("<u4"))
                    out.append({"id": key, "start": row["base"] + start, "n_tokens": end - start, "ids_crc32": zlib.crc32(own), **({"tokens": own.tolist()} if with_ids else {})})
                    start = end
                yield pa.RecordBatch.from_pylist(out, schema)

    return read_shards(spark, path).mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long" + (", tokens array<long>" if with_ids else ""))


def lookup(spark: SparkSession, path: str, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, tokens): the documents whose ids wanted has, once per row of the file, each decoded from its own marks only.

    Ids of shards are met by a join; a shard without a wanted document is not read further."""
    shards = spark.read.parquet(path)
    at = shards.select("range", "shard", F.posexplode("ids").alias("place", "id")).join(wanted.select(F.col(id_col).cast("long").alias("id")).distinct(), "id", "left_semi")
    asked = at.groupBy("range", "shard").agg(F.sort_array(F.collect_list("place")).alias("places"))
    schema = pa.schema([("id", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                yield pa.RecordBatch.from_pylist([{"id": shard.ids[k], "tokens": shard.document(k).tolist()} for k in row["places"]], schema)

    return shards.join(asked, ["range", "shard"]).mapInArrow(run, "id long, tokens array<long>")


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """One row: ids in the file, bytes of its symbols, rules and marks, and bytes of the ids as they are, two each or four."""
    wide = F.when(F.col("first") > 1 << 16, 4).otherwise(2)
    kept = F.octet_length("symbols") + F.octet_length("rules") + F.octet_length("lengths") + F.octet_length("marks")
    return spark.read.parquet(path).agg(F.sum("n_ids").alias("n_ids"), F.sum(kept.cast("long")).alias("bytes"), F.sum(F.col("n_ids") * wide).alias("plain_bytes"))


def tokenised(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes docs as a token file in the shared folder and reads its documents back."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, **options)
    return read_documents(docs.sparkSession, path)
