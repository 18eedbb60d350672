"""Personal data: fixed patterns, and a semi-Markov conditional random field.

The patterns find e-mail addresses, IPv4 addresses, payment cards and phone numbers.
The field adds what has no fixed form: secrets, SSNs and IBANs. It scores whole
candidate segments (their shape, entropy, checksums, and the words before
them) and picks boundaries and types together by dynamic programming over segments
of MOST_TOKENS tokens at most, of any length; what follows an assignment (``password = ...``, ``password is ...``, in four
languages) is a candidate up to the next white space, however many tokens it has. Candidates are segments of LEAST characters or more
with a digit, an @ or the start of a known kind of key; those of digits and signs alone, and those with a space, only
where they have the form of a card, phone, address, SSN or IBAN (printed in groups, too). It also knows the four pattern kinds, so that it doesn't
take their parts for something else; of what it finds, kinds without a pattern are added,
but for what cuts a pattern's span or lies in one (a long key may hold digits that pass for a card).

Weights are trained here, by gradient ascent on the conditional likelihood of
TRAINING generated sentences (forward-backward over segments). The segmentation is
only computed near what any candidate has (digits, @, key starts, an assignment): elsewhere
none passes the field's hard filter, so leaving it out changes nothing. Candidates are scored as they come and
not held: a window costs some 40 bytes a token, however long it is.

Cases: a null or empty text has no spans. Texts of any length are searched whole; the work
is linear in it. Repeated rows get the same spans. An empty table gives an empty
result. Lone surrogates can't occur in Spark strings. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from heapq import merge

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small_batches

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "ssn", "iban")
KINDS = BASE + ADDED
MOST_TOKENS = 16
TRAINING = 560
REACH = 64
LEAST = 6

Span = tuple[str, int, int]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number's first digit has no digit before it: a later start of the same run matches only if the first does.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


#: A digit doubled, and the digits of that summed.
_DOUBLED = str.maketrans("0123456789", "0246813579")


def luhn(digits: str) -> bool:
    return (sum(map(int, digits[::-2])) + sum(map(int, digits[-2::-2].translate(_DOUBLED)))) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards, so that long runs without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > done and _LOCAL.match(text[first - 1]):
            first -= 1
        if first < at and (m := _DOMAIN.match(text, at + 1)):
            yield first, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    out = [("email", a, b) for a, b in emails(text)]
    if not _DIGIT.search(text):
        return out
    if text.count(".") >= 3:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := re.sub(r"[\x20-]", "", m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# -- the field -------------------------------------------------------------------------

_TOKEN = re.compile(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]")
_ANCHOR = re.compile(r"[0-9@]+|(?<![A-Za-z0-9_])(?:AKIA|ASIA|ghp_|sk_|xox|AIza)")
#: Words before a segment, by what they announce.
_CUES = {
    "secret": "password passwd pwd secret token api_key apikey key auth credential access bearer",
    "phone": "phone tel call mobile fax",
    "card": "card visa mastercard credit",
    "ssn": "ssn social security",
    "iban": "iban account bank konto",
    "email": "email mail contact",
}
_CUE_OF = {w: k for k, ws in _CUES.items() for w in ws.split()}
#: Words to which a secret is assigned, in English, German, French and Spanish, and what stands between them and it.
_ASSIGNED = re.compile(
    r"(?i)(?<![^\W_])(?:pass(?:word|wd|phrase|code)|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer"
    r"|pass ?wort|kennwort|geheimnis|schl\u00fcssel|mot de passe|jeton|cl\u00e9|secr\u00e8te?|contrase\u00f1a|clave|secreto)[\"']?(?:[ \t]{0,3}[:=][ \t]{0,3}|[ \t]{1,3}(?:is|ist|est|es)[ \t]{1,3})[\"'`]?(?=[A-Za-z0-9+/_$])"
)
_RUN = re.compile(r"[^\s\"'`,;<>()\[\]{}|]+")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?")
_KEY_START = re.compile(r"AKIA|ASIA|ghp_|sk_|xox|AIza")
_IBAN_START = re.compile(r"[A-Z]{2}[0-9]{2}")
_EDGE = "([+"
_JOINS = "@+()./-"
#: Kinds of tokens.
_SIGN, _DIGITS, _ANCHORED, _WORD, _AT = range(5)


def iban_valid(s: str) -> bool:
    s = s.replace(" ", "")
    return bool(_IBAN.fullmatch(s)) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def span_features(text: str, a: int, b: int, cue: str | None, assigned: bool = False, whole: bool = False) -> list[str]:
    """Features of a whole segment; the weights are by kind and feature. ``assigned``: it follows an assignment; ``whole``: up to the next white space or quote."""
    s = text[a:b]
    digits = sum(c.isdigit() for c in s)
    letters = sum(c.isalpha() for c in s)
    solid = s.replace("_", "").isalnum()
    d = re.sub(r"[\x20-]", "", s)
    f = ["bias", f"size{min(len(s) // 6, 7)}", f"digits{min(digits // 3, 6)}", f"entropy{int(entropy(s) * 2)}"]
    f.append(f"cue-{cue}" if cue else "no-cue")
    if cue and solid:
        f.append(f"cue-solid-{cue}")
    if assigned:
        f.append("assigned" + ("-run" if whole else "-part"))
        if not digits:
            plain = s.isalpha() and (s.islower() or s.istitle())
            f.append(f"letters-{'plain' if plain else 'odd'}{min(len(s) // 4, 5)}")
    if (a and (text[a - 1].isalnum() or text[a - 1] in "_-.@+")) or (b < len(text) and (text[b].isalnum() or text[b] in "_@")):
        f.append("cut-word")
    if b + 1 < len(text) and text[b] in ".-" and text[b + 1].isalnum():
        f.append("cut-word")
    if solid and digits and letters:
        f.append("mixed" + ("-hex" if re.fullmatch("[0-9a-f]+", s) else "-upper" if s.isupper() else "-any") + ("-long" if len(s) >= 16 else ""))
        if digits >= 3 and len(s) >= 16:
            f.append("key-like")
    if _KEY_START.match(s) and len(s) >= 16:
        f.append("key-start")
    if "@" in s:
        f.append("is-email" if next(emails(s), None) == (0, len(s)) else "odd-at")
    if _IP.fullmatch(s):
        f.append("is-ip" if all(len(p) <= 3 and int(p) <= 255 for p in s.split(".")) else "odd-ip")
    if d.isdigit():
        f.append("is-card" if 13 <= len(d) <= 19 and luhn(d) else "number")
        if (a > 1 and text[a - 1] == " " and text[a - 2].isdigit()) or (b + 1 < len(text) and text[b] == " " and text[b + 1].isdigit()):
            f.append("cut-number")
    if _PHONE.fullmatch(s):
        f.append("is-phone" if 9 <= digits <= 15 else "odd-phone")
    if _SSN.fullmatch(s):
        f.append("is-ssn")
    if _IBAN.fullmatch(s):
        f.append("is-iban" if iban_valid(s) else "odd-iban")
    if " " in s:
        f.append("has-space")
    return f


def runs_in(text: str, lo: int = 0, hi: int | None = None) -> Iterator[tuple[int, int]]:
    """Starts and ends of what is assigned, up to white space or a quote and without closing marks."""
    for m in _ASSIGNED.finditer(text, lo, len(text) if hi is None else hi):
        if r := _RUN.match(text, m.end()):
            yield m.end(), m.end() + len(r[0].rstrip(".:!?"))


def tokenize(text: str, lo: int, hi: int) -> tuple[array, array, bytearray]:
    """Starts, ends and kinds of a window's tokens."""
    first, end, kinds = array("q"), array("q"), bytearray()
    for m in _TOKEN.finditer(text, lo, hi):
        w = m[0]
        first.append(m.start())
        end.append(m.end())
        if w.isascii() and w.isdigit():
            kinds.append(_DIGITS)
        elif _ANCHOR.search(w):
            kinds.append(_AT if w == "@" else _ANCHORED)
        else:
            kinds.append(_WORD if w[0].isalnum() or w[0] == "_" else _SIGN)
    return first, end, kinds


def fixed_form(text: str, a: int, b: int, n_tokens: int, digits: int) -> bool:
    """Whether digits and signs are an SSN, an address, a phone number or a card that passes its check."""
    if n_tokens == 5 and b - a == 11 and _SSN.fullmatch(text, a, b):
        return True
    if n_tokens == 7 and b - a <= 15 and _IP.fullmatch(text, a, b):
        return True
    if text[a] == "+":
        return 9 <= digits <= 15 and bool(_PHONE.fullmatch(text, a, b))
    if not 13 <= digits <= 19:
        return False
    d = text[a:b].replace(" ", "").replace("-", "")
    return d.isdigit() and luhn(d) and bool(_CARD.fullmatch(text, a, b))


def candidates(text: str, tokens: tuple[array, array, bytearray], runs: dict[int, int]) -> Iterator[tuple[int, int, list[str]]]:
    """Candidate segments (first token, end token, features), by first token. ``runs``: start and end of what is assigned."""
    first, end, kinds = tokens
    n = len(first)
    for i in range(n):
        a, kind = first[i], kinds[i]
        run = runs.get(a) if runs else None
        if kind == _AT or (kind == _SIGN and text[a] not in _EDGE) or text[a] == "_":
            if run is None:
                continue
        cue = None
        iban = kind == _ANCHORED and bool(_IBAN_START.match(text, a))
        seen, plain, spaced, joined, digits = run is not None, True, False, False, 0
        for j in range(i, min(n, i + MOST_TOKENS)):
            k, b = kinds[j], end[j]
            if j > i and first[j] > end[j - 1]:
                if first[j] - end[j - 1] > 1 or text[first[j] - 1] != " ":
                    break  # entities have single spaces at most
                spaced = True
            if k == _DIGITS:
                digits += b - first[j]
                seen = True
            elif k == _SIGN:
                joined = joined or text[b - 1] in _JOINS
                continue
            else:
                plain = False
                seen = seen or k != _WORD
                joined = joined or k == _AT
            if spaced and (digits > 19 if plain else not iban):
                break
            if b - a < LEAST or not seen or b == run or k == _AT or text[b - 1] == "_":
                continue
            if plain and (spaced or run is None):
                if (digits < 13 and b - a > 15 and kind != _SIGN) or not fixed_form(text, a, b, j + 1 - i, digits):
                    continue
            elif spaced:
                if not _IBAN.fullmatch(text, a, b):
                    continue
            elif j > i and not joined:
                continue
            cue = cue or ("secret" if run is not None else _cue(text, first, end, i))
            yield i, j + 1, span_features(text, a, b, cue or None, run is not None)
        # The whole of what is assigned, of however many tokens.
        if run is not None and run - a >= LEAST and (j := bisect_left(end, run, i)) < n and end[j] == run:
            yield i, j + 1, span_features(text, a, run, "secret", True, True)


def _cue(text: str, first: array, end: array, i: int) -> str:
    """What the nearest of the three tokens before announces, if any does."""
    return next((c for k in range(i - 1, max(-1, i - 4), -1) if (c := _CUE_OF.get(text[first[k] : end[k]].lower()))), "")


def lattice(text: str, lo: int, hi: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, list[str]]]]:
    """Tokens of a window, and its candidate segments (first token, end token, features)."""
    tokens = tokenize(text, lo, hi)
    return list(zip(tokens[0], tokens[1])), list(candidates(text, tokens, dict(runs_in(text, lo, hi))))


def _paths(n: int, segments: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Log sums of all segmentations of the first k and of the last n - k tokens; a token outside scores 0."""
    ends: dict[int, list[tuple[int, np.ndarray]]] = {}
    starts: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, j, s in segments:
        ends.setdefault(j, []).append((i, s))
        starts.setdefault(i, []).append((j, s))
    fore, back = np.zeros(n + 1), np.zeros(n + 1)
    for k in range(1, n + 1):
        fore[k] = np.logaddexp.reduce([fore[k - 1], *(fore[i] + x for i, s in ends.get(k, ()) for x in s)])
    for k in range(n - 1, -1, -1):
        back[k] = np.logaddexp.reduce([back[k + 1], *(back[j] + x for j, s in starts.get(k, ()) for x in s)])
    return fore, back


def sentences(n: int, seed: int = 3) -> list[tuple[str, list[Span]]]:
    """Generated sentences with entities and with look-alikes that are none."""
    r = random.Random(seed)
    low, hexa, up = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    word = lambda: pick(low, r.randint(2, 12))
    number = lambda k: pick("0123456789", k)

    def card(valid: bool) -> str:
        while True:
            d = number(16)
            if luhn(d) == valid:
                return d if r.random() < 0.6 else " ".join(d[i : i + 4] for i in range(0, 16, 4))

    def iban(valid: bool) -> str:
        land = r.choice(["DE", "GB", "FR", "NO", "ES", "NL", "IT", "PL"])
        tail = (pick(up[:26], 4) if r.random() < 0.3 else "") + pick(up if r.random() < 0.2 else "0123456789", r.randint(11, 24))
        right = 98 - int("".join(str(int(c, 36)) for c in f"{tail}{land}00")) % 97
        made = f"{land}{right if valid else (right + r.randint(1, 90)) % 97:02d}{tail}"
        return made if r.random() < 0.5 else " ".join(made[i : i + 4] for i in range(0, len(made), 4))

    def secret() -> tuple[str, str, str]:
        value = r.choice([pick(hexa, r.choice([18, 24, 32, 40])), "AKIA" + pick(up, 16), "ghp_" + pick(r.choice([low + up, low + up[:26]]), 36), pick(low + up, r.randint(20, 40))])
        if value.startswith(("AKIA", "ghp_")) and r.random() < 0.7:
            return "", value, ""
        key, quote = r.choice(["password", "token", "secret", "api_key", "pwd", "passwort", "mot de passe", "contrase\u00f1a", "clave"]), r.choice(["", '"', "'"])
        if r.random() < 0.5:
            mixed = low + up.lower().upper() + low.upper()
            value = r.choice([
                "".join(word().title() for _ in range(r.randint(3, 5))), pick(mixed, r.choice([60, 160, 400])), pick(hexa, r.choice([64, 128, 160])),
                pick(mixed, r.randint(10, 16)) + r.choice("+/-.") + pick(mixed, r.randint(8, 30)), ".".join(pick(mixed, r.randint(20, 60)) for _ in range(3)),
                "-".join(pick(mixed, 4) for _ in range(r.randint(4, 24))), pick(mixed, r.randint(7, 12)) + number(2), pick(up[:26], 1) + pick(low, r.randint(3, 7)) + number(r.randint(2, 6)) + pick(low, r.randint(0, 4)), pick(low, 6) + "_" + pick(mixed, 8) + number(2),
            ])
        return f"{key}{r.choice(['=', ' = ', ': ', ' is '])}{quote}", value, quote

    makers = {
        "email": lambda: ("", f"{word()}.{number(2)}@{word()}.example.com", ""),
        "ip": lambda: ("", ".".join(str(r.randint(1, 255)) for _ in range(4)), ""),
        "card": lambda: ("", card(True), ""),
        "phone": lambda: ("", r.choice([f"+1 ({number(3)}) {number(3)}-{number(4)}", f"+{r.randint(20, 99)} {number(3)} {number(3)} {number(4)}"]), ""),
        "secret": secret,
        "ssn": lambda: (r.choice(["", "ssn ", "SSN: "]), f"{number(3)}-{number(2)}-{number(4)}", ""),
        "iban": lambda: (r.choice(["", "IBAN ", "account "]), iban(True), ""),
    }
    others = [
        lambda: number(r.randint(1, 12)), lambda: card(False), lambda: f"{number(4)}-{number(2)}-{number(2)}", lambda: f"{word()}{number(2)}",
        lambda: f"v{number(1)}.{number(1)}.{number(2)}", lambda: f"{number(3)}.{number(3)}.{r.randint(256, 999)}.{number(3)}", lambda: f"{word()}{word()}{number(1)}",
        lambda: f"https://{word()}.example.org/{word()}/{number(4)}", lambda: f"the key {word()} token {number(3)}", lambda: f"{number(2)}:{number(2)}", lambda: f"${number(3)}.{number(2)}",
        lambda: f"{word().upper()}{number(2)}", lambda: f"password {word()} {number(2)}", lambda: f"{word()}-{number(3)}-{word()}", lambda: iban(False), lambda: f"the {r.choice(['password', 'token', 'secret'])} is {r.choice([str, str.title])(pick(low, r.randint(2, 11)))}",
        lambda: f"{r.choice(['password', 'token', 'clave', 'secret'])}: {pick(low, r.randint(2, 9))}", lambda: f"{r.choice(['token', 'passwort'])}: {pick(low, r.randint(2, 9)).title()}", lambda: f"ISBN {number(3)}-{number(1)}-{number(5)}-{number(3)}-{number(1)}",
    ]
    out = []
    for k in range(n):
        text, gold = " ".join(word() for _ in range(r.randint(1, 5))), []
        for _ in range(r.randint(1, 2)):
            kind = KINDS[k % len(KINDS)] if not gold else r.choice(KINDS)
            if r.random() < 0.4:
                text += " " + r.choice(others)()
            else:
                before, value, after = makers[kind]()
                text += " " + before
                gold.append((kind, len(text), len(text) + len(value)))
                text += value + after
            text += r.choice(["", ",", "."]) + " " + " ".join(word() for _ in range(r.randint(1, 4)))
        out.append((text, gold))
    return out


@lru_cache(maxsize=1)
def weights(n: int = TRAINING, rounds: int = 14, rate: float = 0.5) -> dict[str, np.ndarray]:
    """Feature -> weight by kind, from adaptive gradient ascent with an L2 penalty."""
    cases, names = [], {}
    for text, gold in sentences(n):
        tokens, segments = lattice(text, 0, len(text))
        right = {(a, b): KINDS.index(k) for k, a, b in gold}
        made = []
        for i, j, f in segments:
            for x in f:
                names.setdefault(x, len(names))
            made.append((i, j, np.array([names[x] for x in f]), right.get((tokens[i][0], tokens[j - 1][1]), -1)))
        cases.append((len(tokens), made))
    w = np.zeros((len(names), len(KINDS)))
    w[names["bias"]] = -3.0
    seen = np.full_like(w, 1e-2)
    for _ in range(rounds):
        for size, made in cases:
            scored = [(i, j, w[f].sum(axis=0)) for i, j, f, _ in made]
            fore, back = _paths(size, scored)
            g = np.zeros_like(w)
            for (i, j, f, kind), (_, _, s) in zip(made, scored):
                expected = np.exp(np.minimum(fore[i] + s + back[j] - fore[size], 0))
                change = -expected
                if kind >= 0:
                    change[kind] += 1
                np.add.at(g, f, change)
            g -= 2e-4 * w
            seen += g * g
            w += rate * g / np.sqrt(seen)
    return {x: w[i] for x, i in names.items()}


def decode(text: str, lo: int, hi: int, w: dict[str, np.ndarray]) -> list[Span]:
    """The best segmentation of a window."""
    tokens = tokenize(text, lo, hi)
    first, end, _ = tokens
    n, at = len(first), 0
    # The best score of the first k tokens, and the segment that ends there (its first token, its kind), if one does.
    best, come, kinds = array("d", [0.0]) * (n + 1), array("q", [-1]) * (n + 1), bytearray(n + 1)

    def settle(to: int) -> None:
        nonlocal at
        while at < to:
            at += 1
            if best[at - 1] >= best[at]:
                best[at], come[at] = best[at - 1], -1

    scores: dict[tuple[str, ...], tuple[float, int]] = {}
    for i, j, f in candidates(text, tokens, dict(runs_in(text, lo, hi))):
        settle(i)
        if (known := scores.get(key := tuple(f))) is None:
            s = sum(w[x] for x in f if x in w)
            k = int(np.argmax(s))
            known = scores[key] = float(s[k]), k
        score, k = known
        if score > 0 and best[i] + score > best[j]:  # one below 0 never beats leaving its tokens outside
            best[j], come[j], kinds[j] = best[i] + score, i, k
    settle(n)
    out, k = [], n
    while k > 0:
        i = come[k]
        if i >= 0:
            out.append((KINDS[kinds[k]], first[i], end[k - 1]))
        k = i if i >= 0 else k - 1
    return out[::-1]


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around anchors and assignments, wide enough for any segment and its cues, in order and apart, that cut no token."""
    lo = hi = -1
    for a, b in merge((m.span() for m in _ANCHOR.finditer(text)), runs_in(text)):
        if hi >= 0 and a - REACH * 2 <= hi:
            hi = max(hi, _right(text, b)) if b > hi - REACH * 2 else hi
            continue
        if hi >= 0:
            yield lo, hi
        lo, hi = _left(text, a, hi), _right(text, b)
    if hi >= 0:
        yield lo, hi


def _inside(text: str, k: int) -> bool:
    return 0 < k < len(text) and (text[k].isalnum() or text[k] == "_") and (text[k - 1].isalnum() or text[k - 1] == "_")


def _left(text: str, at: int, least: int) -> int:
    at = max(0, least, at - REACH * 2)
    while at > least and _inside(text, at):
        at -= 1
    return at


def _right(text: str, at: int) -> int:
    at = min(len(text), at + REACH * 2)
    while _inside(text, at):
        at += 1
    return at


def find_spans(text: str | None, w: dict[str, np.ndarray]) -> list[Span]:
    """All spans by kind, then start."""
    text = text or ""
    found = base_spans(text)
    # Spans of one kind are in order and apart.
    taken = [([a for k, a, _ in found if k == kind], [b for k, _, b in found if k == kind]) for kind in BASE]

    def fits(lo: int, hi: int) -> bool:
        """No pattern's span is cut, equal or around."""
        return all(
            lo <= a and b <= hi and b - a < hi - lo
            for starts, ends in taken
            for a, b in zip(*(x[bisect_right(ends, lo) : bisect_left(starts, hi)] for x in (starts, ends)))
        )

    for lo, hi in windows(text):
        found += [s for s in decode(text, lo, hi, w) if s[0] in ADDED and fits(s[1], s[2])]
    return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1]))


def redact(text: str, spans: list[Span]) -> str:
    """Each span becomes its kind in brackets; of overlapping ones, the first in the text names the whole."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, redacted string"


def find_pii(docs: DataFrame, keep: list[str], with_text: bool = False) -> DataFrame:
    """``keep`` columns, base counts and digest, all spans, and (if asked for) the redacted text."""
    from pyspark.sql.types import StructType

    w = weights()
    small_batches(docs.sparkSession)
    d = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("_text"))
    schema = StructType([*docs.select(*[F.col(f"`{c}`") for c in keep]).schema.fields, *StructType.fromDDL(SCHEMA).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(len(keep)):
                text = t.as_py()
                spans = find_spans(text, w)
                base = [s for s in spans if s[0] in BASE]
                n = Counter(s[0] for s in base)
                changed = None if text is None or not with_text else redact(text, spans)
                rows.append((*(n[k] for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans), changed))
            made = list(zip(*rows)) or [[]] * 8
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *(pa.array(c, t) for c, t in zip(made, types))], schema.fieldNames())

    return d.mapInArrow(run, schema)


def redact_documents(docs: DataFrame) -> DataFrame:
    """The documents with their spans replaced in ``text``; a null text stays null."""
    # The text goes to Python once, so it is left out of the row that is carried along.
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    d = docs.select(F.struct(F.lit(0).alias("_"), *rest).alias("_row"), "text")
    out = find_pii(d, ["_row"], with_text=True)
    made = {"text": F.col("redacted"), "n_chars": F.coalesce(F.length("redacted").cast("long"), F.col("_row.n_chars") if "n_chars" in docs.columns else F.lit(None))}
    return out.select(*[made[c].alias(c) if c in made else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
