"""Token ids of whole texts, with a cache of the pieces between white space.

Both tokenizers' pre-tokenizers end a token where a non-space is followed by white
space, and look no further than the white space before a word. So a text's ids
are the ids of its chunks (white space, then a word) one after the other, and
a chunk that was met before needs no second encoding. The cache has two generations, whose
memory is bounded by ``CACHE`` bytes together, or what a caller allows; results do not depend on it.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE = 160 << 20
#: Where a worker keeps its cache between tasks.
KEPT = 320 << 20
#: Longer chunks are not kept. A kept one takes so many bytes: its text (two bytes a character), its ids, and its place in the table.
LONGEST = 64
ENTRY = 240
_MARKS = ".,!?;:|*%$&#"
#: How byte-level vocabularies write a space.
_SPACE = chr(0x120)
#: Unicode's White_Space, as the tokenizers' patterns have it.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
#: Between words, anything but a single space or line feed.
_ODD = re.compile("[\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class _Young(dict):
    """Chunk -> its ids as little-endian bytes. One that is too long to be kept is encoded anew."""

    __slots__ = ("encode",)

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        return self.encode(chunk)


class _Chunks:
    """``young``: chunks that were met lately; ``old``: the generation before."""

    def __init__(self, tokenizer, prefix: str, code: str, cache: int) -> None:
        self.tokenizer, self.prefix, self.code, self.cache = tokenizer, prefix, code, cache
        self.clear()
        ids = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
        self.folds = ids("\nA") == ids("a")
        tokens = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
        self.at_end = any(t.endswith("</w>") for t in tokens)
        self.edges = np.array([t.endswith("</w>") if self.at_end else t.startswith(_SPACE) for t in tokens])

    def clear(self) -> None:
        self.young, self.old, self.runs = _Young(self._encode), {}, {}

    def _ids(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _encode(self, chunk: str) -> bytes:
        return self._ids(chunk if chunk[:1] == "\n" else self.prefix + chunk)

    def parts(self, chunk: str) -> tuple[str, str]:
        """A chunk whose ids it has, and marks that follow.

        Between a letter and a mark a token always ends (but for letters that are a letter and an accent in lower
        case). Where the tokenizer drops white space and case, an ASCII word stands for all its forms.
        """
        core = chunk.rstrip(_MARKS)
        if core and core[-1].isalpha() and len(core[-1].lower()) == 1:
            run = chunk[len(core) :]
        else:
            core, run = chunk, ""
        return (core.lower().lstrip("\n"), run) if self.folds and core.isascii() else (core, run)

    def _encode_words(self, words: list[str]) -> None:
        """Encode words of letters as one text, and part its ids again where a word begins (or ends).

        Each such word is one pre-token, so its first id is one with a space (or its last one with a word end).
        Should the count of these differ from that of the words, nothing is kept.
        """
        if not (self.prefix and words):
            return
        ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)[0].ids)
        edge = np.flatnonzero(self.edges[ids]) + self.at_end
        if len(edge) != len(words):
            return
        width = array(self.code).itemsize
        raw = ids.astype(f"<u{width}").tobytes()
        cuts = (edge * width).tolist()
        cuts = [0, *cuts] if self.at_end else [*cuts, len(raw)]
        young = self.young
        for c, a, b in zip(words, cuts, cuts[1:]):
            young[c] = raw[a:b]

    def learn(self, chunks: set[str]) -> None:
        """Encode what is new in one call, which costs less than a call for each."""
        # Two generations. An encoder's other set of chunks is for texts with odd white space; it takes a quarter at most.
        if len(self.young) * ENTRY > (3 * self.cache // 8 if self.prefix else self.cache // 8):
            self.old, self.young = self.young, _Young(self._encode)
            self.runs.clear()
        young, old, made, folds, prefix = self.young, self.old, [], self.folds, self.prefix
        known = old.get
        fresh = chunks.difference(young)
        again = fresh & old.keys()
        young.update(zip(again, map(known, again)))
        fresh = {c for c in fresh - again if len(c) <= LONGEST}
        # The same as parts(), without its call for the many plain words.
        plain = dict.fromkeys(c for c in fresh if c.isalpha() and not (folds and c.isascii() and not c.islower()))
        for c in fresh.difference(plain):
            core, run = self.parts(c)
            if core != c:
                made.append((c, core, run))
                if core in young:
                    continue
                if (ids := known(core)) is not None:
                    young[core] = ids
                    continue
            plain[core] = None
        if plain:
            self._encode_words([c for c in plain if c.isalpha()])
            rest = [c for c in plain if c not in young]
            code = self.code
            texts = [c if c[:1] == "\n" else prefix + c for c in rest]
            for c, e in zip(rest, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                young[c] = array(code, e.ids).tobytes()
        runs = self.runs
        for c, core, run in made:
            ids = runs.get(run)
            if ids is None:
                ids = runs[run] = self._ids(run)
            young[c] = young[core] + ids


class Encoder:
    """``ids(texts)``: for each text its ids, as bytes of ``dtype``."""

    def __init__(self, path: str, dtype: str = "<u4", cache: int = CACHE) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        if tokenizer.get_vocab_size() > 1 << (8 * np.dtype(dtype).itemsize):
            raise ValueError(f"{dtype} can't hold this vocabulary's ids")
        self.dtype = np.dtype(dtype)
        code = {2: "H", 4: "I"}[self.dtype.itemsize]
        self.first = _Chunks(tokenizer, "", code, cache)
        self.spaced = _Chunks(tokenizer, " ", code, cache)

    def ids(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain = [i for i, t in enumerate(texts) if self._plain(t)]
        for i, x in zip(plain, self._plain_ids([texts[i] for i in plain])):
            out[i] = x
        done = set(plain)
        odd = [(i, _CHUNK.findall(t)) for i, t in enumerate(texts) if i not in done]
        self.first.learn(set().union(*(s for _, s in odd)))
        first = self.first.young.__getitem__
        for i, s in odd:
            out[i] = b"".join(map(first, s))
        return out

    def _plain_ids(self, texts: list[str]) -> list[bytes]:
        """Words are numbered by Arrow, so that a word is looked up once; its ids are gathered by number wherever it stands."""
        if not texts:
            return []
        lists = pc.split_pattern(pa.array([t.replace("\n", " \n") for t in texts], pa.large_string()), " ")
        numbered = lists.flatten().dictionary_encode()
        code = numbered.indices.to_numpy().copy()
        # By way of NumPy, as to_pylist makes an object of Arrow's for each word first.
        words = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        edge = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        # A text's first word has no space before it: it gets a number of its own.
        heads = [words[k] for k in code[edge[:-1]]]
        code[edge[:-1]] = len(words) + np.arange(len(texts))
        self.spaced.learn({w for w in words if w})
        self.first.learn({w for w in heads if w})
        spaced, first = self.spaced.young, self.first.young
        pieces = [spaced[w] if w else b"" for w in words] + [first[w] if w else b"" for w in heads]
        flat = np.frombuffer(b"".join(pieces), dtype=self.dtype)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) // self.dtype.itemsize
        n = size[code]
        end = np.cumsum(n)
        at = np.repeat((np.cumsum(size) - size)[code] - (end - n), n)
        at += np.arange(len(at))
        ids, ends = flat[at], end[edge[1:] - 1].tolist()
        return [ids[a:b].tobytes() for a, b in zip([0, *ends], ends)]

    def clear(self) -> None:
        """Forget all chunks, as at a task's end: the worker lives on and idles beside other stages."""
        self.first.clear()
        self.spaced.clear()

    @staticmethod
    def _plain(text: str) -> bool:
        """True if all words but the first stand for a space and themselves, or begin with their line feed."""
        return not ("  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[-1:] in ("", " ") or _ODD.search(text))


@lru_cache(maxsize=4)
def id_type(path: str) -> str:
    """The narrowest type that holds all ids of a vocabulary."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


@lru_cache(maxsize=1)
def encoder(path: str, dtype: str = "<u4", cache: int = CACHE) -> Encoder:
    """One for each Python worker."""
    return Encoder(path, dtype, cache)


def slices(sizes: list[int], most: int = 4_200_000) -> list[slice]:
    """Runs of texts of about ``most`` characters, so that a batch of long texts is not held at once."""
    out, first, n = [], 0, 0
    for i, s in enumerate(sizes):
        n += s
        if n >= most:
            out.append(slice(first, i + 1))
            first, n = i + 1, 0
    return [*out, slice(first, len(sizes))] if first < len(sizes) else out
