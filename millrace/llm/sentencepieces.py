"""SentencePiece encoding of merge-type vocabularies.

A text becomes symbols; an agenda holds every adjacent pair that spells a
piece, best score first and leftmost among equals; the best pair is merged and
its new neighbours enter the agenda, until it is empty. Symbols that are no
piece become byte pieces.

No piece has a blank mark behind another character, and some characters (such
as the line end) are in no longer piece, so that no merge crosses the start of
a word: words are encoded one by one and kept in two generations of a bounded dictionary. What is
new in an Arrow batch is encoded by the library too, in one call; where the
two disagree the library's ids are taken and counted.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .texts import batch_of, rows_of, texts_of

_BLANK = "▁"


class PieceEncoder:
    def __init__(self, path: str, limit: int = 250_000):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        n = lib.get_piece_size()
        special = {i for i in range(n) if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i)}
        self.pieces = {lib.id_to_piece(i): (-lib.get_score(i), i) for i in range(n) if i not in special and not lib.is_unused(i)}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown, self.begin, self.end = lib.unk_id(), lib.bos_id(), lib.eos_id()
        long = [p for p in self.pieces if len(p) > 1]
        # Word by word needs: no piece across the start of a word, text taken as it is, one blank put before it.
        self.by_word = not any(_BLANK in p.lstrip(_BLANK) for p in long) and not any("\n" in p for p in long) \
            and self._as_it_is() and all(lib.is_byte(i) for i in self.bytes)
        self.limit, self.words, self.older, self.replaced = limit, {}, {}, {}

    def _as_it_is(self) -> bool:
        """Whether the model neither normalises texts nor drops blanks."""
        odd = " a  ééﬁⅧ \n　A "
        return self.library.decode(self.library.encode(odd)) == odd

    def merge(self, chunk: str) -> list[int]:
        """Ids of one run of symbols, by the agenda."""
        pieces = self.pieces
        symbols = list(chunk)
        last = len(symbols)
        after, before = list(range(1, last + 1)), list(range(-1, last - 1))
        agenda = []
        for i in range(last - 1):
            made = symbols[i] + symbols[i + 1]
            if made in pieces:
                agenda.append((pieces[made][0], i, made))
        heapq.heapify(agenda)
        while agenda:
            _, i, made = heapq.heappop(agenda)
            j = after[i]
            if symbols[i] is None or j >= last or symbols[i] + symbols[j] != made:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = made, None
            after[i] = k = after[j]
            if k < last:
                before[k] = i
                if (new := made + symbols[k]) in pieces:
                    heapq.heappush(agenda, (pieces[new][0], i, new))
            if (h := before[i]) >= 0 and (new := symbols[h] + made) in pieces:
                heapq.heappush(agenda, (pieces[new][0], h, new))
        ids: list[int] = []
        for s in symbols:
            if s is not None:
                if s in pieces:
                    ids.append(pieces[s][1])
                else:
                    ids += [self.bytes[b] for b in s.encode()]
        return ids

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Runs that no merge leaves: blanks before a word belong to it, a line end starts a run of its own."""
        words = text.replace(_BLANK, " ").replace("\n", " \n").split(" ")
        if "" not in words:
            return words
        made, blanks = [], 0
        for w in words:
            if not w:
                blanks += 1
            elif w[0] == "\n":
                made += [" " * (blanks - 1)] * (blanks > 0) + [w]
                blanks = 0
            else:
                made.append(" " * blanks + w)
                blanks = 0
        return made + [" " * (blanks - 1)] * (blanks > 0)

    def encode_batch(self, texts: list[str]) -> tuple[list[bytes], list[int]]:
        """Ids of each text with begin and end, as little-endian unsigned 32-bit integers, and how many of its words the library gives otherwise.

        Ids are those of the agenda, word by word where pieces allow it and
        else text by text. All that is new is encoded by the library too,
        whose ids replace those that differ.
        """
        pack = lambda ids: struct.pack(f"<{len(ids)}I", *ids)
        begin, end = pack([self.begin]), pack([self.end])
        if not self.by_word:
            merged = [self.merge(_BLANK + t.replace(" ", _BLANK)) if t else [] for t in texts]
            checked = self.library.encode(texts, num_threads=1)
            return [begin + pack(a if a == b else b) + end for a, b in zip(merged, checked)], [int(a != b) for a, b in zip(merged, checked)]
        split = [self.chunks(t) if t else [] for t in texts]
        if len(self.words) > self.limit:
            self.older, self.words = self.words, {}
        known, older = self.words, self.older
        unseen = {w for words in split for w in words if w not in known}
        known |= {w: older[w] for w in unseen if w in older}
        new = [w for w in unseen if w not in known]
        for w, theirs in zip(new, self.library.encode(new, num_threads=1)):
            if w[:1] == "\n":
                ours, theirs = self.merge(w), theirs[1:]  # the library puts a blank before it
            else:
                ours = self.merge(_BLANK + w.replace(" ", _BLANK))
                if not w:
                    theirs = ours  # a blank alone; the library gives nothing for an empty text
            if ours != theirs:
                self.replaced[w] = pack(theirs)
            known[w] = pack(ours)
        if self.replaced:
            known |= {w: ids for w, ids in self.replaced.items() if w in known}
        find, other = known.__getitem__, self.replaced
        return [begin + b"".join(map(find, words)) + end for words in split], [sum(w in other for w in words) if other else 0 for words in split]

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, dtype="<u4").tolist())


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One for each vocabulary and Python worker, kept between tasks."""
    return PieceEncoder(path)


_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_differ", pa.int64())])
#: Texts encoded at once, so that the ids of a batch stay small beside the texts.
_AT_ONCE = 500


def _slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, _AT_ONCE):
            yield batch.slice(at, _AT_ONCE)


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): ids with begin and end, as little-endian unsigned 32-bit integers in one binary value.

    Null texts are empty (begin and end alone), null ids stay null, repeated
    rows are answered each, an empty table gives no rows, other columns are
    not read. Nothing is shuffled.
    """
    def run(batches):
        own = encoder(path)
        for part in _slices(batches):
            ids, texts = zip(*rows_of(part))
            yield batch_of(_IDS, list(zip(ids, own.encode_batch(list(texts))[0])))

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def decode_pieces(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from `encode_pieces`."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        own = encoder(path)
        for part in _slices(batches):
            yield batch_of(schema, [(i, own.decode(b)) for i, b in zip(part.column("doc_id").to_pylist(), part.column("ids").to_pylist())])

    return encoded.mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of each text's ids and of what they decode to, in one pass; `n_differ` counts its words for which the library's ids were taken."""
    def run(batches):
        own = encoder(path)
        sha: Callable = lambda b: hashlib.sha256(b).hexdigest()
        for part in _slices(batches):
            ids, texts = zip(*rows_of(part))
            made, differ = own.encode_batch(list(texts))
            yield batch_of(_DIGESTS, [(i, len(b) // 4, sha(b), sha(own.decode(b).encode()), n) for i, b, n in zip(ids, made, differ)])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_differ long")
