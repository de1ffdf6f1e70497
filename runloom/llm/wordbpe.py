"""Word-level BPE as a bounded-lookahead streaming transducer, and an incremental decoder.

The transducer reads symbols (bytes; the last byte of a word is a symbol of its own kind) and keeps, for each recent
position, the last token of the encoding of the text up to there.  Two tokens may stand side by side exactly if no
merge crosses their border before both are complete, so a position's last token is the one that fits behind the last
token at its own start.  A later position can only be reached through one of the newest ``longest`` positions: once
their chains of tokens meet, everything before the meeting point is stable and is emitted.  ``lookahead`` is computed
from the merge list; the buffer holds about that many symbols, whatever the length of the input.

Texts: null and empty ones have no ids.  Texts are read a few megabytes at a time and brought to normal form there.  A
special token's string is its id and a border.  Only a stretch between blanks that holds a character which Python's
Unicode does not assign, or one of the few marks that the library's older tables order or compose otherwise, is left to
the tokenizers library; tests compare code points of all planes.

Decoding is a state machine: token strings in, text out, holding the bytes of a character that is not complete.
"""

from __future__ import annotations

import codecs
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

SPACE, LETTER, NUMBER, OTHER, SLOW = 0, 1, 2, 3, 4
#: Word ends carry this offset: the last byte b of a word is the symbol b + END.
END = 256


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies, by rule: printable Latin-1 stays, the rest follows from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of each code point of a text in normal form; SLOW where none is assigned.  U+0130, the only
    one with a lower case of two characters, is replaced before."""
    kind = np.full(0x110000, OTHER, np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        cat = unicodedata.category(x := chr(c))
        if cat[0] == "L":
            kind[c] = LETTER
        elif cat[0] == "N":
            kind[c] = NUMBER
        elif cat == "Cn":
            kind[c] = SLOW
            continue
        if cat in ("Lu", "Lt", "Nl", "So") and len(low := x.lower()) == 1:
            lower[c] = ord(low)
    kind[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return kind, lower


def odd_marks(normalize) -> set[int]:
    """Marks that another implementation of the normal form, of an older Unicode, does not order or compose as Python's does."""
    out: set[int] = set()
    for c in range(0x300, 0x110000):
        x = chr(c)
        if unicodedata.combining(x):
            if any(normalize(t) != unicodedata.normalize("NFC", t) for t in (f"a{x}\u0301", f"a{x}\u0323", f"a{x}\u0334", f"a\u0345{x}", f"a\u0301{x}")):
                out.add(c)
        elif (parts := unicodedata.decomposition(x)) and parts[0] != "<" and normalize(flat := unicodedata.normalize("NFD", x)) != unicodedata.normalize("NFC", flat):
            out |= {c, ord(flat[-1])}
    return out


def normal(text: str) -> str:
    return unicodedata.normalize("NFC", text).replace("\u0130", "i\u0307")


class Merges:
    """The merge list as a relation between tokens, and what follows from it."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = "</w>"):
        alphabet = byte_alphabet()

        def symbols(token: str) -> str:
            end = token.endswith(suffix) and len(token) > len(suffix)
            body = [alphabet[c] for c in (token[: -len(suffix)] if end else token)]
            return "".join(map(chr, body[:-1])) + chr(body[-1] + END * end)

        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.ids = {symbols(t): i for t, i in vocab.items()}
        self.rank: dict[tuple[str, str], int] = {}
        self.parts: dict[str, tuple[str, str, int]] = {}
        for r, (a, b) in enumerate(pairs):
            a, b = symbols(a), symbols(b)
            self.rank.setdefault((a, b), r)
            for x in (a, b):
                if len(x) > 1 and x not in self.parts:
                    raise ValueError("merge list is not proper: a merge uses a token that no earlier merge makes")
            self.parts.setdefault(a + b, (a, b, r))
        #: Tokens that encoding can give: single symbols, and those that a merge makes.
        self.tokens = {t for t in self.ids if len(t) == 1} | {t for t in self.parts if t in self.ids}
        self.longest = max(map(len, self.tokens))
        self.lookahead = self._lookahead()
        lengths: dict[str, set[int]] = {}
        for t in self.tokens:
            lengths.setdefault(t[-2:], set()).add(len(t))
        self.lengths = {tail: tuple(sorted(n, reverse=True)) for tail, n in lengths.items()}
        self._right: dict[str, list[tuple[str, float]]] = {}
        self._left: dict[str, list[tuple[str, float]]] = {}

    def _lookahead(self) -> int:
        """Symbols over which a change at the end can pass to the left: it goes from a merge (y, z) to a later merge
        (x, y) that wants the same y, so the heaviest chain of such merges bounds it; the longest token is added for
        the border at which the chain ends."""
        reach: dict[str, int] = {}
        for (x, y), _ in sorted(self.rank.items(), key=lambda m: m[1]):
            reach[x] = max(reach.get(x, 0), len(x) + max(len(y), reach.get(y, 0)))
        return max(reach.values(), default=1) + self.longest

    def _spine(self, token: str, right: bool) -> list[tuple[str, float]]:
        """The pieces at one border of a token, from its symbol up, each with the rank of the merge that takes it."""
        store = self._right if right else self._left
        if (spine := store.get(token)) is None:
            spine, until, piece = [], float("inf"), token
            while True:
                spine.append((piece, until))
                if len(piece) == 1:
                    break
                a, b, until = self.parts[piece]
                piece = b if right else a
            spine.reverse()
            store[token] = spine
        return spine

    def fits(self, a: str, b: str) -> bool:
        """Whether a and b stay side by side: no merge over their border comes while both its pieces are there."""
        left, right = self._spine(a, True), self._spine(b, False)
        i = j = 0
        rank = self.rank
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            r = rank.get((x, y))
            if r is not None and r < x_until and r <= y_until:
                return False
            if x_until == y_until == float("inf"):
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1


class Transducer:
    """Feeds on symbols of one word and gives tokens once they are stable; ``close`` gives the rest."""

    def __init__(self, merges: Merges, known: dict[tuple[str, str], bool] | None = None, most_known: int = 1_000_000):
        self.merges, self.known, self.most_known = merges, {} if known is None else known, most_known
        self.reset()

    def reset(self) -> None:
        self.text, self.last, self.most_held = "", [None], 0

    def feed(self, symbols: str) -> list[str]:
        """Tokens that are stable now."""
        out: list[str] = []
        step = self.merges.lookahead
        for at in range(0, len(symbols), step):
            self._advance(symbols[at : at + step])
            if len(self.text) > 2 * step:
                out += self._emit()
        return out

    def _advance(self, symbols: str) -> None:
        m, known, last, offset = self.merges, self.known, self.last, len(self.text)
        text = self.text = self.text + symbols
        tokens, lengths = m.tokens, m.lengths
        for i in range(offset + 1, len(text) + 1):
            found = None
            for n in lengths.get(text[max(0, i - 2) : i], (1,)):
                if n > i:
                    continue
                t = text[i - n : i]
                if t not in tokens:
                    continue
                before = last[i - n]
                if before is None:
                    if i == n and self.whole(t):
                        found = t
                        break
                    continue
                fit = known.get((before, t))
                if fit is None:
                    if len(known) >= self.most_known:
                        known.clear()
                    fit = known[before, t] = m.fits(before, t)
                if fit:
                    found = t
                    break
            if found is None:
                found = text[i - 1]
            last.append(found)
        self.most_held = max(self.most_held, len(text))

    def whole(self, token: str) -> bool:
        """Every token that a merge list's own merges make is its own encoding if its two parts meet first."""
        known = self.known
        if (ok := known.get((token, ""))) is None:
            parts = self.merges.parts.get(token)
            ok = known[token, ""] = parts is None or greedy(self.merges, token) == [token]
        return ok

    def _emit(self) -> list[str]:
        """Emits up to the position at which the chains of all positions within reach meet."""
        last, n = self.last, len(self.text)
        heads = set(range(max(0, n - self.merges.longest + 1), n + 1))
        while len(heads) > 1:
            top = max(heads)
            heads.discard(top)
            heads.add(top - len(last[top]) if top else 0)
        meet = heads.pop()
        out = self._back(meet)
        if meet:
            held = last[meet]
            # The token before the kept part stays known, as the left neighbour of what follows.
            keep = meet - len(held)
            out.pop()
            self.text, self.last = self.text[keep:], [last[keep] if keep else None, *last[keep + 1 :]]
        return out

    def _back(self, at: int) -> list[str]:
        out, stop = [], 0
        while at > stop:
            out.append(t := self.last[at])
            at -= len(t)
        return out[::-1]

    def close(self) -> list[str]:
        out = self._back(len(self.text))
        self.text, self.last = "", [None]
        return out


def greedy(merges: Merges, symbols: str) -> list[str]:
    """Brute force: the lowest merge first, the leftmost of equals."""
    parts = list(symbols)
    while len(parts) > 1:
        r, i = min((merges.rank.get((parts[i], parts[i + 1]), float("inf")), i) for i in range(len(parts) - 1))
        if r == float("inf"):
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def _merge_core(merges: Merges):
    """The compiled merge loop of tiktoken over the same merges: 0xFF, which no UTF-8 text holds, marks the word end
    and joins the last byte before anything else.  It merges by the rank of what a merge makes; that is the same as
    by pair if every token's own encoding is the token, which the tests verify for the whole vocabulary."""
    import tiktoken

    flat = lambda t: bytes(ord(c) & 0xFF for c in t) + (b"\xff" if ord(t[-1]) >= END else b"")
    ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 255]): 256 + b for b in range(256)}
    of_rank = {b: merges.ids.get(chr(b), 0) for b in range(256)} | {256 + b: merges.ids.get(chr(b + END), 0) for b in range(256)}
    for t, (_, _, r) in merges.parts.items():
        ranks[flat(t)] = 512 + r
        of_rank[512 + r] = merges.ids[t]
    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe, of_rank


class ByteText:
    """Bytes in, text out: holds the bytes of a character that is not complete, at most three."""

    def __init__(self):
        self._state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, data: bytes) -> str:
        return self._state.decode(data)

    def close(self) -> str:
        return self._state.decode(b"", True)


class Decoder:
    """Ids in, text out: each id's bytes, ``between`` them, through ByteText.  Its state is that and whether it has begun."""

    def __init__(self, of_id: list[bytes], between: bytes = b""):
        self.of_id, self.between, self.begun, self.state = of_id, between, False, ByteText()

    def feed(self, ids: Iterable[int]) -> str:
        of_id = self.of_id
        parts = [of_id[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)]
        if not parts:
            return ""
        if self.begun:
            parts.insert(0, b"")
        self.begun = True
        return self.state.feed(self.between.join(parts))

    def close(self) -> str:
        self.begun = False
        return self.state.close()


class WordBPE:
    """Encodes and decodes texts by a word-end BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str, streaming: bool = True, most_words: int = 150_000):
        self.path, self.most_words = path, most_words
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._border = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        strings = dict(model["vocab"]) | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [b""] * (max(strings.values()) + 1)
        for t, i in strings.items():
            self.strings[i] = t.encode()
        back, end = byte_alphabet(), model["end_of_word_suffix"]
        self.raw = [b""] * len(self.strings)
        for t, i in model["vocab"].items():
            body = t[: -len(end)] if t.endswith(end) and len(t) > len(end) else t
            self.raw[i] = bytes(back[c] for c in body) + (b" " if body != t else b"")
        for t in spec["added_tokens"]:
            self.raw[t["id"]] = t["content"].encode() + b" "
        self.kind, self.lower = _tables()
        from tokenizers import normalizers

        self.kind[list(odd_marks(normalizers.NFC().normalize_str))] = SLOW
        self.words: dict[str, tuple[int, ...]] = {}
        self.transducer = Transducer(self.merges)
        self.merge_core = None if streaming else _merge_core(self.merges)
        self._library = None

    # encoding

    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library

    def word(self, word: str) -> tuple[int, ...]:
        if (ids := self.words.get(word)) is None:
            data, t = word.encode("utf-8"), self.transducer
            if self.merge_core is not None:
                core, of_rank = self.merge_core
                ids = tuple([of_rank[r] for r in core.encode_single_piece(data + b"\xff")])
            else:
                tokens = t.feed(data[:-1].decode("latin-1") + chr(data[-1] + END))
                tokens += t.close()
                ids = tuple(map(self.merges.ids.__getitem__, tokens))
            if len(word) <= 64:
                if len(self.words) >= self.most_words:
                    self.words.clear()
                self.words[word] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        return next(iter(self.encode_all(pa.array([text], pa.string()))))

    def encode_all(self, texts: pa.Array, most_bytes: int = 1_000_000) -> Iterator[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers."""
        held = []
        for ids, last in self.emitted(texts, most_bytes):
            held.append(ids)
            if last:
                yield held[0] if len(held) == 1 else np.concatenate(held)
                held = []

    def emitted(self, texts: pa.Array, most_bytes: int = 1_000_000) -> Iterator[tuple[np.ndarray, bool]]:
        """Ids as they come, and whether they end a text; works through a few megabytes at a time.  A longer text is read
        in pieces that end before a space or line feed, over which no word goes."""
        texts = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = memoryview(texts.buffers()[2]) if texts.buffers()[2] is not None else memoryview(b"")
        at = 0
        while at < len(texts):
            if offsets[at + 1] - offsets[at] > 2 * most_bytes:
                low, end = int(offsets[at]), int(offsets[at + 1])
                while low < end:
                    high = self._blank(data, low, end, most_bytes)
                    yield self._encode_part([bytes(data[low:high]).decode("utf-8", "replace")])[0], high == end
                    low = high
                at += 1
                continue
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1)
            raw, cuts = bytes(data[int(offsets[at]) : int(offsets[end])]), (offsets[at : end + 1] - offsets[at]).tolist()
            for ids in self._encode_part([raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)]):
                yield ids, True
            at = end

    @staticmethod
    def _blank(data: memoryview, low: int, end: int, size: int) -> int:
        for start in range(low + size, end, size):
            found = [x for x in (bytes(data[start : start + size]).find(c) for c in (b" ", b"\n")) if x >= 0]
            if found:
                return min(end, start + min(found))
        return end

    def _encode_part(self, texts: list[str]) -> list[np.ndarray]:
        given, text = texts, "".join(texts)
        special = [any(s in t for s in self.special) for t in texts] if "<" in text and any(s in text for s in self.special) else None
        if not text.isascii() and not (unicodedata.is_normalized("NFC", text) and "\u0130" not in text):
            texts = [t if t.isascii() else normal(t) for t in texts]
            text = "".join(texts)
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=bounds[1:])
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        kind = self.kind[chars]
        bad = np.zeros(len(texts), bool)
        if len(slow := np.flatnonzero(kind == SLOW)):
            bad[np.unique(np.searchsorted(bounds, slow, "right") - 1)] = True
        if special is not None:
            bad |= np.array(special)
        for d in np.flatnonzero(bad):
            kind[bounds[d] : bounds[d + 1]] = SPACE
        out = self._encode_fast(chars, kind, bounds)
        for d in np.flatnonzero(bad):
            out[d] = self._mixed(given[d])
        return out

    def _mixed(self, text: str) -> np.ndarray:
        """Special tokens as their ids; stretches with unassigned characters, from blank to blank, by the library."""
        out: list[np.ndarray] = []
        for piece in self._border.split(text) if self._border else [text]:
            if piece in self.special:
                out.append(np.array([self.special[piece]], np.uint32))
                continue
            held: list[str] = []
            for stretch in re.split("(?<=[ \n])", piece):
                if (self.kind[np.frombuffer(stretch.encode("utf-32-le", "surrogatepass"), "<u4")] == SLOW).any():
                    out += self._encode_part(["".join(held)])
                    held = []
                    out.append(np.array(self.library().encode(stretch, add_special_tokens=False).ids, np.uint32))
                else:
                    held.append(stretch)
            out += self._encode_part(["".join(held)])
        return np.concatenate([*out, np.zeros(0, np.uint32)])

    def _encode_fast(self, chars: np.ndarray, kind: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        n = len(bounds) - 1
        low = self.lower[chars]
        start = np.empty(len(chars) + 1, bool)
        start[0], start[-1] = True, True
        np.not_equal(kind[1:], kind[:-1], out=start[1:-1])
        start[:-1] |= kind == NUMBER
        start[bounds] = True
        if len(quote := np.flatnonzero((low == 39) & start[:-1])):
            first = np.zeros(len(chars) + 1, bool)
            first[bounds] = True
            pad = np.concatenate([low, np.zeros(3, low.dtype)])
            pad[-3:] = 0
            inside = ~first[quote + 1]
            a, b = pad[quote + 1], np.where(first[np.minimum(quote + 2, len(chars))], 0, pad[quote + 2])
            one = inside & np.isin(a, [ord(c) for c in "stmd"])
            two = inside & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
            start[quote[one | two] + 1] = False
            start[quote[one] + 2] = True
            start[quote[two] + 3] = True
        keep = kind != SPACE
        begins = np.flatnonzero(start[:-1] & keep)
        kept = low[keep]
        data = kept.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace")
        order = np.cumsum(keep) - 1
        width = 1 + (kept > 0x7F).astype(np.int64) + (kept > 0x7FF) + (kept > 0xFFFF)
        byte_at = np.zeros(len(kept) + 1, np.int64)
        np.cumsum(width, out=byte_at[1:])
        offsets = np.append(byte_at[order[begins]], byte_at[-1]).astype(np.int32)
        words = pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)).dictionary_encode()
        index = np.asarray(words.indices)
        known, word = self.words, self.word
        encoded = [known.get(w) or word(w) for w in words.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        flat = np.fromiter(chain.from_iterable(encoded), np.uint32, int(sizes.sum()))
        first_of = np.cumsum(sizes) - sizes
        each = sizes[index]
        upto = np.zeros(len(index) + 1, np.int64)
        np.cumsum(each, out=upto[1:])
        ids = flat[np.repeat(first_of[index] - upto[:-1], each) + np.arange(upto[-1])]
        cuts = upto[np.searchsorted(begins, bounds)]
        return [ids[cuts[d] : cuts[d + 1]] for d in range(n)]

    # decoding

    def decoder(self) -> Decoder:
        """What the library's decode gives for this vocabulary: token strings with spaces between."""
        return Decoder(self.strings, b" ")

    def text_decoder(self) -> Decoder:
        """The text that ids stand for, word ends as spaces."""
        return Decoder(self.raw)


_loaded: dict[tuple[str, bool], WordBPE] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def loaded(path: str, streaming: bool = False) -> WordBPE:
    """One encoder for each worker process and file.  streaming: words go through the transducer; otherwise through a compiled merge loop with the same results."""
    if (path, streaming) not in _loaded:
        _loaded[path, streaming] = WordBPE(path, streaming)
    return _loaded[path, streaming]
