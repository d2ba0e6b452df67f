"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The encoder keeps an agenda of adjacent symbol pairs that form a vocabulary piece, ordered by
score and then by place, and joins the best pair until none is left. Symbols that end up
outside the vocabulary are spelled in byte pieces.

No piece of the supported vocabularies has a word mark (U+2581) after another character, so no
join crosses such a border: the text is cut there and equal words are encoded once per worker.
``Pieces`` verifies that property and otherwise treats the text as one word. The new words of an
Arrow batch go through the agenda together, one row of a matrix each, and are all compared with the
sentencepiece library, ids and decoded text.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame

from tideline.llm.batches import extend_rows

MARK = "▁"
#: Words up to this many characters are joined together by ``join_rows``, in blocks of
#: so many.
SHORT, BLOCK = 48, 4096
#: Words that the library takes as one text.
TOGETHER = 256
NEVER = np.int32(1 << 30)
SPACED = re.compile(" +[^ ]*")


class Pieces:
    """One vocabulary. Supported: BPE models with the identity normalizer, a dummy prefix, byte
    fallback and no user-defined or unused pieces; others raise ``ValueError``."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        n = model.normalizer_spec
        normal, byte = 1, 6  # piece types of the format
        kinds = {p.type for p in model.pieces}
        if model.trainer_spec.model_type != 2 or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or kinds & {4, 5} or byte not in kinds:
            raise ValueError("only plain BPE vocabularies with byte fallback and the identity normalizer are supported")
        self.text = [p.piece for p in model.pieces]
        self.spelled = [x.replace(MARK, " ") for x in self.text]
        self.decimal = [str(i) for i in range(len(self.text))]
        self.score = {p.piece: -p.score for p in model.pieces if p.type == normal}
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == normal}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == byte}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.hidden = {i for i, p in enumerate(model.pieces) if p.type == 3}
        self.plain = {i for i, p in enumerate(model.pieces) if p.type == normal}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        self.whole = any(MARK in p.lstrip(MARK) for p in self.score)  # no borders inside a text
        self._tables()

    def _tables(self) -> None:
        """The vocabulary as arrays: the symbol of a character (``none`` if it is not a piece), which
        pairs of symbols join to which, and the rank of a symbol's score."""
        known, self.none = self.id, len(self.text)
        self.symbol = np.full(0x110000, self.none, np.int32)
        for p, i in known.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        pairs = sorted((known[p[:k]] * (self.none + 1) + known[p[k:]], i) for p, i in known.items() for k in range(1, len(p)) if p[:k] in known and p[k:] in known)
        self.pair, self.joined = (np.array(x, kind) for x, kind in zip(zip(*pairs, strict=True), (np.int64, np.int32), strict=True))
        ids = np.fromiter(known.values(), np.int64, len(known))
        ranks = np.unique(np.fromiter((self.score[p] for p in known), float, len(known)), return_inverse=True)[1]
        self.rank = np.full(self.none + 1, NEVER, np.int32)
        self.rank[ids] = ranks

    def split(self, text: str | None) -> list[str]:
        """The words of a text, each without the first of the spaces that stand before it."""
        if not text:
            return []
        words = [text] if self.whole else text.split(" ")
        return [w[1:] for w in SPACED.findall(f" {text}")] if "" in words else words

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What pairs of symbols join to, ``none`` for nothing."""
        key = left.astype(np.int64) * (self.none + 1) + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.joined[at], self.none).astype(np.int32)

    def join_rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The agendas of many short words, one a row: in every round each word joins its best
        pair, the leftmost of equals. Returns the symbols that are left, word by word, and for
        each of them its place (row and character)."""
        rows, width = len(words), max(map(len, words))
        points = np.array(words, f"<U{width}").view(np.uint32).reshape(rows, width)
        symbols = np.full((rows, width + 2), self.none, np.int32)  # one more on both sides, which joins with nothing
        symbols[:, 1:-1] = self.symbol[points]
        inside = np.arange(width) < np.fromiter(map(len, words), np.int64, rows)[:, None]
        symbols[:, 1:-1][~inside] = self.none
        after, before = (np.tile(np.arange(d, width + 2 + d, dtype=np.int16), (rows, 1)) for d in (1, -1))
        made = np.full((rows, width + 2), self.none, np.int32)
        made[:, :-1] = self._pairs(symbols[:, :-1], symbols[:, 1:])
        agenda = self.rank[made]
        open_rows = np.arange(rows)
        while True:
            best = agenda[open_rows].argmin(1)
            more = agenda[open_rows, best] < NEVER
            r, i = open_rows[more], best[more]
            if not len(r):
                break
            open_rows = r
            j = after[r, i]
            k = after[r, j]
            pair = made[r, i]
            symbols[r, i], symbols[r, j], agenda[r, j] = pair, -1, NEVER
            after[r, i], before[r, k] = k, i
            h = before[r, i]
            both = self._pairs(np.concatenate([pair, symbols[r, h]]), np.concatenate([symbols[r, k], pair]))
            made[r, i], made[r, h] = both[: len(r)], both[len(r) :]
            agenda[r, i], agenda[r, h] = self.rank[made[r, i]], self.rank[made[r, h]]
        left = inside & (symbols[:, 1:-1] >= 0)
        return symbols[:, 1:-1][left], np.argwhere(left)

    def join_long(self, word: str) -> list[str]:
        """The symbols of one word after all joins. The agenda is a heap of (score, place, pair); an
        entry is stale if the symbol at its place no longer begins that pair."""
        score = self.score.get
        symbols: list = list(word)
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols)))  # one more: the end of the word takes writes too
        symbols.append("")
        agenda = []
        left, seen = 0, symbols[0]
        for symbol in symbols[1:-1]:
            pair = seen + symbol
            if (s := score(pair)) is not None:
                agenda.append((s, left, pair))
            left, seen = left + 1, symbol
        heapify(agenda)
        while agenda:
            _, left, pair = heappop(agenda)
            right = after[left]
            if symbols[left] + symbols[right] != pair or not symbols[left] or not symbols[right]:
                continue  # one of the two was joined elsewhere meanwhile
            symbols[left], symbols[right] = pair, ""
            after[left] = beyond = after[right]
            before[beyond] = left
            if symbols[beyond] and (s := score(new := pair + symbols[beyond])) is not None:
                heappush(agenda, (s, left, new))
            back = before[left]
            if back >= 0 and (s := score(new := symbols[back] + pair)) is not None:
                heappush(agenda, (s, back, new))
        return [s for s in symbols if s]

    def encode_words(self, words: list[str]) -> tuple[list[int], list[int], set[int]]:
        """The ids of words of ``split`` (each has a mark before it), one after another; where each
        word's ids end; and the words (by place) that have byte pieces. Words of about equal lengths
        should stand together."""
        flat: list[int] = []
        ends: list[int] = []
        odd: set[int] = set()
        at = 0
        while at < len(words):
            block = []
            for word in words[at : at + BLOCK]:
                if len(word) >= SHORT:
                    break
                block.append(MARK + word.replace(" ", MARK))
            if not block:
                symbols = self.join_long(MARK + words[at].replace(" ", MARK))
                flat += [x for s in symbols for x in ([self.id[s]] if s in self.id else self.bytes_of(s))]
                ends.append(len(flat))
                if not self.plain.issuperset(flat[ends[-2] if at else 0 :]):
                    odd.add(at)
                at += 1
                continue
            symbols, places = self.join_rows(block)
            rows, ids = places[:, 0], symbols
            unknown = np.flatnonzero(symbols == self.none)
            if len(unknown):
                odd.update((at + np.unique(rows[unknown])).tolist())
                spelled = [self.bytes_of(block[r][c]) for r, c in places[unknown].tolist()]
                counts = np.ones(len(symbols), np.int64)
                counts[unknown] = [len(x) for x in spelled]
                first = np.cumsum(counts) - counts
                rows, ids = np.repeat(rows, counts), np.repeat(symbols, counts)
                for k, x in zip(first[unknown].tolist(), spelled, strict=True):
                    ids[k : k + len(x)] = x
            ends += (len(flat) + np.searchsorted(rows, np.arange(1, len(block) + 1))).tolist()
            flat += ids.tolist()
            at += len(block)
        return flat, ends, odd

    def bytes_of(self, symbol: str) -> list[int]:
        return [self.byte[b] for b in symbol.encode("utf-8")]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_words(self.split(text))[0]

    def spell(self, ids: list[int]) -> str:
        """Decoded text with its leading space still on."""
        if self.plain.issuperset(ids):
            return "".join([self.spelled[i] for i in ids])
        out, pending = [], bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                pending.append(b)
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            if i not in self.hidden:
                out.append(" ⁇ " if i == self.unknown else self.text[i])
        out.append(pending.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ")

    def decode(self, ids: list[int]) -> str:
        return self.spell(ids).removeprefix(" ")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Pieces:
    """One per worker."""
    return Pieces(path)


class CheckedWords:
    """The ids of words, and their decoded texts, both held against the library before use. Words
    are kept in two generations of ``half`` each: when the young one is full it becomes the old one,
    and words still in use move back."""

    def __init__(self, pieces: Pieces, half: int = 400_000):
        self.pieces, self.half = pieces, half
        self.ids: dict[str, str] = {}
        self.old: dict[str, str] = {}
        #: Decoded texts of words that decode to something else than themselves.
        self.changed: dict[str, str] = {}

    def learn(self, lists: list[list[str]]) -> None:
        """Afterwards ``ids`` has all these words."""
        if len(self.ids) > self.half:
            self.old, self.ids = self.ids, {}
            if len(self.changed) > self.half:
                self.old, self.changed = {}, {}
        missing = set(chain.from_iterable(lists)).difference(self.ids)
        old = self.old
        self.ids |= {w: old[w] for w in missing if w in old}
        new = sorted((w for w in missing if w not in old), key=len)
        flat, ends, odd = self.pieces.encode_words(new)
        decimal, spelled = ([names[i] for i in flat] for names in (self.pieces.decimal, self.pieces.spelled))
        ids, texts, start = [], [], 0
        for n, end in enumerate(ends):
            ids.append(",".join(decimal[start:end]))
            texts.append("".join(spelled[start:end]) if n not in odd else self.pieces.spell(flat[start:end]))
            start = end
        for n, theirs in self.differing(new, flat, ends, texts).items():
            ids[n], texts[n] = theirs
        self.ids.update(zip(new, ids, strict=True))
        self.changed.update((word, text[1:]) for word, text in zip(new, texts, strict=True) if text[1:] != word)

    def differing(self, words: list[str], flat: list[int], ends: list[int], texts: list[str]) -> dict[int, tuple[str, str]]:
        """Ids and decoded text by the library for words (by place) where it has others. It takes
        many words as one text; words of nothing but spaces, which would become part of the next
        word, are texts of their own, behind a letter. Where a text differs, its words are looked
        at one by one."""
        library, whole = self.pieces.library, self.pieces.whole
        lone = [n for n, w in enumerate(words) if whole or not w.strip(" ")]
        joint = range(len(words))
        if lone:
            joint = sorted(set(joint).difference(lone))
        starts = [0, *ends]
        for at in range(0, len(joint), TOGETHER):
            part = joint[at : at + TOGETHER]
            own = flat[starts[part[0]] : ends[part[-1]]] if not lone else [i for n in part for i in flat[starts[n] : ends[n]]]
            if library.encode(" ".join([words[n] for n in part]), num_threads=1) != own or library.decode(own) != "".join([texts[n] for n in part])[1:]:
                lone += part
        out = {}
        for n in lone:
            before = "" if whole or words[n].strip(" ") else "a "
            skip = library.encode(before[:1])
            ids = library.encode(before + words[n])
            text = library.decode(ids)
            ids, text = ids[len(skip) :], text[1:] if before else f" {text}"
            if ids != flat[starts[n] : ends[n]] or text != texts[n]:
                out[n] = ",".join(map(str, ids)), text
        return out

    def decoded(self, words: list[str]) -> str:
        changed = self.changed
        return " ".join([changed.get(w, w) for w in words] if changed else words)


def encode_documents(docs: DataFrame, model: str, keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """Encode and decode the whole ``text`` of every row.

    Returns the columns ``keep`` (default ``doc_id``), ``n_tokens``, ``ids_sha256``,
    ``decoded_sha256`` and, if ``with_ids``, ``ids`` (array of int) and ``decoded``. Null and
    empty texts have no tokens and decode to an empty text. Repeated rows stay repeated; other
    columns of ``docs``, whatever their names, are left out unless listed in ``keep``; a kept column
    with the name of a result is left out. Where the library has other ids or texts than the
    agenda, the library's are returned. ``model`` is
    a path that every executor can read. Narrow: one pass, no shuffle; memory is one batch, its
    longest text and a cache of at most 800,000 words and a batch (about 170 MB).
    """
    made = [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")] + ([("ids", "array<int>"), ("decoded", "string")] if with_ids else [])

    def make():
        pieces, sha = vocabulary(model), hashlib.sha256
        words = CheckedWords(pieces)

        def work(texts):
            out = []
            lists = [pieces.split(text) for text in texts]
            words.learn(lists)
            cache = words.ids
            for own in lists:
                ids, text = ",".join([cache[w] for w in own]), words.decoded(own)
                found = (ids.count(",") + 1 if own else 0, sha(ids.encode()).hexdigest(), sha(text.encode()).hexdigest())
                out.append((*found, [int(i) for i in ids.split(",")] if ids else [], text) if with_ids else found)
            return out

        return work

    return extend_rows(docs, ["doc_id"] if keep is None else keep, make, made)
