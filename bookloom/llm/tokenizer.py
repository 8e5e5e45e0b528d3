"""Exact token ids of whole texts, with a memo of what stands between white space.

A cut between a character that is not white space and one that is changes no ids: no match of
the pre-tokenisers' patterns holds white space after another character, nothing composes across
the cut, and special strings hold no white space. So ids of a text are those of its pieces
"white space, then other characters", one after another, and a piece met before need not be
encoded again. Piece files (.model) are encoded whole, since their pieces depend on the start.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Callable
from itertools import accumulate

#: Python counts the separators 1C to 1F as white space, the tokenizers' patterns don't.
SPACE = r"[^\S\x1c-\x1f]"
PIECE = re.compile(rf"{SPACE}*[\S\x1c-\x1f]+|{SPACE}+\Z")
#: White space beyond blank and line feed, by which texts leave the quick way of cutting.
OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x85\xa0  -     　]")
#: Marks that no special string and no contraction holds.
MARKS = ".,!?*#$%&;:"
#: Longest piece that is remembered, in characters: texts without blanks are one piece each.
LONGEST = 64


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)



def byte_characters() -> str:
    """The character for each byte in byte-level BPE: itself if it can be seen, else from 256 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return "".join(chr(b if b in seen else next(rest)) for b in range(256))


SHOWN = byte_characters()


def as_bytes(w: str) -> str:
    return w.encode().decode("latin-1").translate(SHOWN)


#: How a word of European letters, after a blank or not, may reach the BPE of a tokenizer file: the
#: steps before it (bytes as characters; lower case without blanks) do nothing else to such words.
#: Going there at once takes a third of the time. A form is used only if it holds for all of PROBES.
FORMS: list[Callable[[str], str]] = [as_bytes, lambda w: as_bytes(w.replace(" ", "").lower())]


#: Letters up to U+017F that stay letters in lower case, after one blank at most.
SIMPLE = re.compile(" ?[" + "".join(c for c in map(chr, range(0x180)) if c.isalpha() and c.lower().isalpha()) + "]+")
#: Characters that are looked up together; what is new in them is encoded at once.
TOGETHER = 100_000

PROBES = [b + w for b in ("", " ") for w in (
    "a", "I", "the", "The", "THE", "camelCase", "XMLHttpRequest", "qzxjkv", "ENENHEITCH", "loweien",
    "internationalisation", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "lll", "s", "ve", "endoftext",
    "été", "Straße", "über", "ÄÖÜ", "ciónñ", "Ÿ", "ŉ", "ſ", "đĐ", "ªº", "µ")]


class Encoder:
    """ids(texts) of one tokenizer file; memo: the most pieces between blanks that are
    remembered, and the most words, each of up to LONGEST characters. Of either, what was met
    since half as many came is kept when room is made, so common ones stay."""

    def __init__(self, path: str, memo: int = 500_000):
        self.path, self.memo = path, memo
        self.pieces: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}  # plain; after a blank
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        self.words: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path)
            self.model.no_truncation()
            self.model.no_padding()
        self.form = next((f for f in FORMS if self._fits(f)), None)
        self.runs = self._runs_fit()

    def _fits(self, form: Callable[[str], str]) -> bool:
        """Whether words of ASCII letters reach the library's BPE in this form."""
        if self.path.endswith(".model"):
            return False
        return all([t.id for t in self.model.model.tokenize(form(w))] == self.whole(w)
                   for w in PROBES)

    def _runs_fit(self) -> bool:
        """Whether ids of a run of pieces can be told apart by where their tokens start."""
        if self.path.endswith(".model"):
            return False
        run = [f"{b}{w}{m}" for w in PROBES for b, m in ((" ", "."), ("\n", ""), (" \"", "1.\nA"))]
        return self._run(run) == [array("I", self.whole(w)).tobytes() for w in run]

    def _run(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that each start with white space and end with another character, encoded as one text."""
        e = self.model.encode("".join(pieces), add_special_tokens=False)
        ids = array("I", e.ids).tobytes()
        starts = [start for start, _ in e.offsets]
        cuts = [4 * bisect_left(starts, end) for end in accumulate(map(len, pieces), initial=0)]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def whole(self, text: str) -> list[int]:
        """Ids straight from the library."""
        if self.path.endswith(".model"):
            return self.model.encode(text)
        return self.model.encode(text, add_special_tokens=False).ids

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Start and end of each token in characters."""
        if self.path.endswith(".model"):
            found = self.model.encode(text, return_type="proto").pieces
            # offsets count bytes; a piece that starts within a character starts with it
            raw = text.encode()
            at = list(accumulate((b & 0xC0 != 0x80 for b in raw), initial=-1))[1:] + [len(text)]
            return [(at[p.begin], at[p.end]) for p in found]
        return self.model.encode(text, add_special_tokens=False).offsets

    def _learn(self, known: dict[str, bytes], keys: set[str], before: str) -> dict[str, bytes]:
        """Ids of pieces not met before, from their word and the marks after it; long ones are forgotten."""
        if len(self.words) > self.memo // 2:
            self.older_words, self.words = self.words, {}
        words, old, unmet = self.words, self.older_words, set()
        whole: list[str] = []
        tails: list[str] = []
        for k in keys:
            w, marks = k.rstrip(MARKS), ""
            # after a letter or digit a mark always starts a match of its own
            if w and w is not k and w[-1] < "\u2000" and w[-1].lower().isalnum():
                marks = k[len(w):]
                unmet.add(marks)
                w = before + w
            else:
                w = before + k
            unmet.add(w)
            whole.append(w)
            tails.append(marks)
        unmet = {w for w in unmet if w not in words}  # difference_update would walk all words
        back = {w: old[w] for w in unmet if w in old}
        words.update(back)
        unmet -= back.keys()
        form, tokenize, simple = self.form, self.model.model.tokenize, SIMPLE.fullmatch
        runs, rest = [], []
        for w in unmet:
            if form and simple(w):
                words[w] = array("I", [t.id for t in tokenize(form(w))]).tobytes()
            elif self.runs and w[:1] in (" ", "\n") and not w[-1].isspace():
                runs.append(w)
            else:
                rest.append(w)
        for at in range(0, len(runs), 1024):
            words.update(zip(runs[at:at + 1024], self._run(runs[at:at + 1024])))
        for at in range(0, len(rest), 4096):
            part = rest[at:at + 4096]
            for w, e in zip(part, self.model.encode_batch_fast(part, add_special_tokens=False)):
                words[w] = array("I", e.ids).tobytes()
        found = {k: words[w] + words[marks] if marks else words[w] for k, w, marks in zip(keys, whole, tails)}
        for w in unmet:
            if len(w) > LONGEST:
                del words[w]
        known.update((k, v) for k, v in found.items() if len(k) <= LONGEST)
        return found

    def _found(self, known: dict[str, bytes], old: dict[str, bytes], keys: list[str], before: str) -> list[bytes]:
        """Ids of each key, met before or not."""
        found = list(map(known.get, keys))
        new = [i for i, v in enumerate(found) if v is None]
        if new:
            unmet = {keys[i] for i in new}
            fresh = {k: old[k] for k in unmet if k in old}
            known.update(fresh)
            if len(fresh) < len(unmet):
                fresh |= self._learn(known, unmet - fresh.keys(), before)
            for i in new:
                found[i] = fresh[keys[i]]
        return found

    def ids(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers."""
        if self.path.endswith(".model"):
            return [array("I", self.whole(t)).tobytes() for t in texts]
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= TOGETHER):
                size += len(texts[end])
                end += 1
            out += self._ids(texts[at:end])
            at = end
        return out

    def _ids(self, texts: list[str]) -> list[bytes]:
        if sum(map(len, self.pieces)) > self.memo // 2:
            self.older, self.pieces = self.pieces, ({}, {})
        (plain, spaced), (old_plain, old_spaced) = self.pieces, self.older
        heads: list[str] = []
        rest: list[str] = []
        ends = [(0, 0)]
        for t in texts:
            if ("  " in t or "\n " in t or t[-1:] in (" ", "\n") or t[:1] == " "
                    or OTHER_SPACE.search(t)):
                heads += PIECE.findall(t)
            else:
                head, *more = t.split(" ")
                heads.append(head)
                rest += more
            ends.append((len(heads), len(rest)))
        first = self._found(plain, old_plain, heads, "")
        then = self._found(spaced, old_spaced, rest, " ")
        return [b"".join(first[a:c] + then[b:d]) for (a, b), (c, d) in zip(ends, ends[1:])]


_open: dict[str, Encoder] = {}


def encoder(path: str, memo: int = 500_000) -> Encoder:
    """The worker's own encoder, opened once; the last caller says how much it remembers."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _open:
        _open[path] = Encoder(path)
    _open[path].memo = memo
    return _open[path]
