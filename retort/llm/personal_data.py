r"""Personal data: fixed patterns, and spans that a semi-Markov conditional random field adds to them.

The patterns (email, ip, card, phone) give the base spans. The model reads the neighbourhoods of digits, of at-marks
(the word in any case or the sign, where some spelling of a dot follows) and of long runs that mix letters and digits, wherever they are in the text. A neighbourhood is cut into
tokens; every stretch of up to MOST_TOKENS tokens is a candidate for each kind (the four, and secret and iban), scored by features of the whole
stretch (number of digits and groups, check digits, octets, separators, brackets, key words before it, what stands next to it). Dynamic
programming over the tokens sums over all segmentations, and so chooses boundaries and kinds together; stretches of the best segmentation
whose probability is at least LEAST_PROBABILITY and that touch no base span are added. The model is fitted on the driver, once a session, to
sentences made from a fixed seed; no document is used.

Defined cases: null text is an empty one and has no spans; positions are code points; rows that repeat are read each;
an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, table

KINDS = ("email", "ip", "card", "phone", "secret", "iban")
#: The first kinds have patterns.
BASE_KINDS = 4
# The base patterns.
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Tokens of one stretch, code points of a neighbourhood on each side of what draws attention, and the longest neighbourhood.
MOST_TOKENS, AROUND, MOST_AROUND, LEAST_PROBABILITY = 24, 30, 400, 0.8
#: The same before and behind an at-mark: a longest name (64), and two longest labels (63) with a spelled dot, with some words beside.
AROUND_NAME, AROUND_DOMAIN = 64 + 20, 2 * 63 + 30


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the patterns' matches, by start, then kind."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), 0))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda x: (x[0], x[2]))


#: A run of 16 or more that mixes letters and digits is one token.
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}=*(?![A-Za-z0-9])")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[+/_-]*[A-Za-z0-9+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}=*(?![A-Za-z0-9])|[A-Za-z]+|[0-9]+|\s+|.", re.S)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_DIGITS = re.compile(r"[0-9][0-9()\x20./-]{5,}[0-9]")
_AT = re.compile(r"[aA][tT](?![^\W_])|@")
#: An address has a dot behind its at-mark, as a word, in brackets, between blanks or between letters.
_ANY_DOT = re.compile(r"(?<![^\W_])[dD][oO][tT](?![^\W_])|[^\W_]\.[^\W_]|[\[({]\s*\.\s*[\])}]|\s\.\s")
_DOT = re.compile(r"\s*[\[({]\s*(?:dot|\.)\s*[\])}]\s*|\s+(?:dot|\.)\s+", re.I)
_KEYS = {"call": "phone", "phone": "phone", "tel": "phone", "mobile": "phone", "fax": "phone", "mail": "email", "email": "email", "contact": "email", "write": "email", "card": "card", "visa": "card", "mastercard": "card", "credit": "card", "ip": "ip", "host": "ip", "server": "ip", "address": "ip", "token": "secret", "secret": "secret", "key": "secret", "apikey": "secret", "password": "secret", "passwd": "secret", "bearer": "secret", "auth": "secret", "iban": "iban", "account": "iban"}
_FEATURES = {k: i for i, k in enumerate((
    "bias", "luhn", "not luhn", "digits<7", "digits7-9", "digits10-11", "digits12-15", "digits16", "digits17+", "groups1", "groups2", "groups3-4", "groups5+",
    "octets", "plus", "bracket", "dots", "hyphens", "blanks", "slashes", "at sign", "spelled at", "spelled dot", "letters", "mixed separators", "other", "starts odd", "ends odd",
    "digit before", "digit after", "word before", "word after", "key", "other key", "three-three-four", "four-four-four-four", "known end",
    "no name", "blank in name", "cut name", "no dot", "blank in domain",
    "run", "hexadecimal", "both cases", "run32+", "quoted", "assigned", "iban check", "country", "dot beside", "dots in name",
))}
_ENDS = frozenset("com org net edu de fr es io info eu uk".split())


def _mixed(run: str) -> bool:
    return any(c.isdigit() for c in run) and any(c.isalpha() for c in run)


def iban_check(text: str) -> bool:
    own = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1


def _near(text: str):
    """Stretches of text that hold something to look at, merged where they meet, each with the start of the first and the end
    of the last thing in it."""
    found = [(m.start(), m.end()) for m in _DIGITS.finditer(text)]
    found += [(a, b) for m in _AT.finditer(text) if not ((a := m.start()) and text[a] != "@" and text[a - 1].isalnum()) and _ANY_DOT.search(text, b := m.end(), b + AROUND_DOMAIN)]
    found += [(m.start(), m.end()) for m in _RUN.finditer(text) if _mixed(m[0])]
    merged: list[list[int]] = []
    for first, last in sorted(found):
        before, behind = (AROUND_NAME, AROUND_DOMAIN) if last - first <= 2 else (AROUND, AROUND)
        a, b = max(0, first - before), min(len(text), last + behind)
        if merged and a <= merged[-1][1] and b - merged[-1][0] <= MOST_AROUND:
            merged[-1][1], merged[-1][3] = max(b, merged[-1][1]), max(last, merged[-1][3])
        else:
            merged.append([a, b, first, last])
    return merged


def _stretches(tokens: list[str]):
    """(first token, token behind, text, features) of the candidates: they start and end on a solid token and hold digits or an address sign."""
    figures, marks_ = [0], [0]  # digits and at-marks before each token
    for t in tokens:
        figures.append(figures[-1] + (len(t) if t.isdigit() and t.isascii() else 0))
        marks_.append(marks_[-1] + (t == "@" or t.lower() == "at"))
    for s, first in enumerate(tokens):
        if len(first) >= 16 and _mixed(first):
            f = ["bias", "run"]
            bare = first.rstrip("=")
            f += [k for k, c in (("hexadecimal", re.fullmatch("[0-9a-fA-F]+", bare)), ("both cases", bare.lower() != bare != bare.upper()), ("run32+", len(bare) >= 32)) if c]
            f += [k for k, c in (("quoted", s and tokens[s - 1] in "\"'`"), ("assigned", any(t in "=:" for t in tokens[max(0, s - 3) : s]))) if c]
            if _IBAN.fullmatch(first):
                f += ["country", *["iban check"] * iban_check(first)]
            yield s, s + 1, [_FEATURES[x] for x in f], {_KEYS[t.lower()] for t in tokens[max(0, s - 6) : s] if t.lower() in _KEYS}
            continue
        if first.isspace() or not (first[0].isalnum() or first in "+("):
            continue
        for e in range(s + 1, min(len(tokens), s + MOST_TOKENS) + 1):
            last = tokens[e - 1]
            if not last.isalnum() or figures[e] - figures[s] < 6 and (e - s < 5 or marks_[e - 1] == marks_[s + 1]):
                continue
            own = tokens[s:e]
            text = "".join(own)
            digits = "".join(t for t in own if t.isdigit() and t.isascii())
            low = [t.lower() for t in own]
            spelled = "at" in low[1:-1] or "@" in own[1:-1]
            if len(digits) < 6 and not (spelled and len(own) >= 5) or "\n" in text:
                continue
            groups = [t for t in own if t.isdigit()]
            f = ["bias"]
            n = len(digits)
            if digits and n >= 12:
                f.append("luhn" if luhn(digits) else "not luhn")
            f.append("digits<7" if n < 7 else "digits7-9" if n < 10 else "digits10-11" if n < 12 else "digits12-15" if n < 16 else "digits16" if n == 16 else "digits17+")
            g = len(groups)
            f.append("groups1" if g <= 1 else "groups2" if g == 2 else "groups3-4" if g < 5 else "groups5+")
            if g == 4 and own == [groups[0], ".", groups[1], ".", groups[2], ".", groups[3]] and all(int(x) <= 255 for x in groups if len(x) < 9):
                f.append("octets")
            marks = {c for t in own for c in t if not t.isalnum()}
            f += [k for k, c in (("plus", "+"), ("bracket", "("), ("dots", "."), ("hyphens", "-"), ("blanks", " "), ("slashes", "/"), ("at sign", "@")) if c in marks]
            if "at" in low[1:-1]:
                f.append("spelled at")
            if "dot" in low[1:-1]:
                f.append("spelled dot")
            if any(t.isalpha() for t in own):
                f.append("letters")
            if len(marks - {"+", "(", ")"}) > 1:
                f.append("mixed separators")
            if marks - set("+(). -/@[]_"):
                f.append("other")
            if [len(x) for x in groups[-3:]] == [3, 3, 4]:
                f.append("three-three-four")
            if [len(x) for x in groups] == [4, 4, 4, 4]:
                f.append("four-four-four-four")
            if low[-1] in _ENDS:
                f.append("known end")
            if len(first) == 2 and _IBAN.fullmatch(text):
                f += ["country", *["iban check"] * iban_check(text)]
            if spelled and len(own) >= 5:
                mark = next(i for i in range(1, len(own) - 1) if low[i] in ("at", "@"))
                name = "".join(own[:mark]).rstrip("[({_- ")
                plain = _DOT.sub(".", name)
                f += [k for k, c in (("no name", not name), ("blank in name", " " in plain), ("dots in name", " " in name and "." in plain)) if c]
                f += ["dot beside"] * ("dot" in [t.lower() for t in tokens[max(0, s - 2) : s] + tokens[e : e + 2]])
                if s and not tokens[s - 1].isspace() and tokens[s - 1] not in ":,;([<":
                    f.append("cut name")
                domain = _DOT.sub(".", "".join(own[mark + 1 :])).lstrip("])}_- ")
                f += [k for k, c in (("no dot", "." not in domain), ("blank in domain", " " in domain)) if c]
            if text.count("(") != text.count(")"):
                f.append("starts odd")
            if text[-1] in "(+":
                f.append("ends odd")
            before = next((t for t in reversed(tokens[max(0, s - 2) : s]) if not t.isspace() and t not in "-.,"), "")
            after = next((t for t in tokens[e : e + 2] if not t.isspace() and t not in "-.,"), "")
            if before.isdigit():
                f.append("digit before")
            if after.isdigit():
                f.append("digit after")
            if s and tokens[s - 1].isalpha():
                f.append("word before")
            if e < len(tokens) and tokens[e].isalpha():
                f.append("word after")
            keys = {_KEYS[t.lower()] for t in tokens[max(0, s - 6) : s] if t.lower() in _KEYS}
            yield s, e, [_FEATURES[x] for x in f], keys


class SemiCrf:
    def __init__(self, weights: np.ndarray | None = None):
        self.w = np.zeros((len(KINDS), len(_FEATURES))) if weights is None else weights

    @staticmethod
    def candidates(tokens: list[str]) -> list[tuple[int, int, int, list[int]]]:
        """(first, behind, kind, features) for each kind of each stretch."""
        out = []
        for s, e, f, keys in _stretches(tokens):
            for k, kind in enumerate(KINDS):
                key = [_FEATURES["key"]] if kind in keys else [_FEATURES["other key"]] if keys else []
                out.append((s, e, k, f + key))
        return out

    @staticmethod
    def _table(own) -> tuple[np.ndarray, np.ndarray]:
        """Kinds, and features padded with one that weighs nothing."""
        f = np.full((len(own), max(len(x[3]) for x in own)), len(_FEATURES))
        for i, x in enumerate(own):
            f[i, : len(x[3])] = x[3]
        return np.array([x[2] for x in own]), f

    def _scores(self, kinds: np.ndarray, f: np.ndarray) -> np.ndarray:
        return np.pad(self.w, ((0, 0), (0, 1)))[kinds[:, None], f].sum(1)

    @staticmethod
    def _sums(n: int, own, scores):
        """log sums over the segmentations of the tokens before and behind each place; a token outside all stretches scores 0."""
        ahead, back = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        ahead[0] = back[n] = 0.0
        ends, starts = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
        for i, (s, e, _, _) in enumerate(own):
            ends[e].append((s, scores[i]))
            starts[s].append((e, scores[i]))
        for j in range(1, n + 1):
            ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(ahead[s] + v for s, v in ends[j])]) if ends[j] else ahead[j - 1]
        for j in range(n - 1, -1, -1):
            back[j] = np.logaddexp.reduce([back[j + 1], *(back[e] + v for e, v in starts[j])]) if starts[j] else back[j + 1]
        return ahead, back

    def fit(self, sentences: list[tuple[list[str], set[tuple[int, int, int]]]], epochs: int = 25, step: float = 0.2) -> SemiCrf:
        data = []
        for tokens, gold in sentences:
            if own := self.candidates(tokens):
                is_gold = np.array([(s, e, k) in gold for s, e, k, _ in own], float)
                data.append((len(tokens), own, *self._table(own), np.array([x[0] for x in own]), np.array([x[1] for x in own]), is_gold))
        m, v, t = np.zeros_like(self.w), np.zeros_like(self.w), 0
        rng = random.Random(2)
        for _ in range(epochs):
            rng.shuffle(data)
            for at in range(0, len(data), 16):
                grad = np.zeros((len(KINDS), len(_FEATURES) + 1))
                for n, own, kinds, f, s, e, gold in data[at : at + 16]:
                    scores = self._scores(kinds, f)
                    ahead, back = self._sums(n, own, scores)
                    d = gold - np.exp(ahead[s] + back[e] + scores - ahead[n])
                    np.add.at(grad, (kinds[:, None], f), d[:, None])
                grad = grad[:, :-1] / 16 - 0.002 * self.w
                t += 1
                m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
                self.w += step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        return self

    def decode(self, tokens: list[str]) -> list[tuple[int, int, int, float]]:
        """(first, behind, kind, probability) of the best segmentation's stretches."""
        own = self.candidates(tokens)
        if not own:
            return []
        n, scores = len(tokens), self._scores(*self._table(own))
        ahead, back = self._sums(n, own, scores)
        best, via, ends = np.zeros(n + 1), [None] * (n + 1), [[] for _ in range(n + 1)]
        for i, (_, e, _, _) in enumerate(own):
            ends[e].append(i)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for i in ends[j]:
                if best[own[i][0]] + scores[i] > best[j]:
                    best[j], via[j] = best[own[i][0]] + scores[i], i
        out, j = [], n
        while j:
            if via[j] is None:
                j -= 1
            else:
                s, e, k, _ = own[via[j]]
                out.append((s, e, k, float(np.exp(ahead[s] + back[e] + scores[via[j]] - ahead[n]))))
                j = s
        return out[::-1]


def made_sentences(n: int = 640, seed: int = 1) -> list[tuple[list[str], set[tuple[int, int, int]]]]:
    """Labelled sentences: personal data in many spellings among look-alikes."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9)))
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card(valid: bool) -> str:
        while True:
            d = num(rng.choice((16, 16, 16, 15, 14)))
            if luhn(d) == valid:
                return d

    def made() -> tuple[str, int | None, str]:
        c = rng.randint(0, 20)
        sep = rng.choice((" ", "-", "."))
        if c < 2:
            return card(True), 2, "card"
        if c == 2:
            d = card(True)
            return rng.choice((" ", "-")).join((d[:4], d[4:8], d[8:12], d[12:])), 2, "card"
        if c < 6:
            return rng.choice((f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}{sep}{num(3)}{sep}{num(4)}", f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(6)}")), 3, "phone"
        if c < 8:
            return rng.choice((f"{word()} at {word()} dot com", f"{word()} [at] {word()} [dot] org", f"{word()}.{num(2)}(at){word()}(dot)net", f"{word()} (at) {word()}.de", f"{word()} dot {word()} at {word()} dot com", f"{word()}.{word()} AT {word()} DOT org")), 0, "email"
        if c == 8:
            return ".".join(str(rng.randint(0, 255)) for _ in range(4)), 1, "ip"
        if c < 12:
            return card(False), None, ""
        if c > 15:
            hex_ = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((32, 40, 64))))
            any_ = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rng.choice((20, 24, 32, 43))))
            run = rng.choice((hex_, hex_.upper(), any_))
            if c < 19:
                return run if _mixed(run) else hex_ + "0a", 4, "secret"
            if c == 19:  # digests, names and versions are no secrets
                return rng.choice((f"commit {hex_}", f"sha {hex_}", f"{word()}{word()}{word()}{num(3)}{word()}", f"{word()}-{word()}-{num(2)}-{num(4)}-{word()}", f"/{word()}/{word()}/{num(4)}/{word()}")), None, ""
            country, rest = rng.choice(("DE", "FR", "ES", "NL", "GB")), num(rng.choice((14, 18, 20)))
            check = 98 - int("".join(str(int(x, 36)) for x in rest + country + "00")) % 97
            iban = f"{country}{check:02d}{rest}"
            return rng.choice((iban, " ".join(iban[i : i + 4] for i in range(0, len(iban), 4)))), 5, "iban"
        return rng.choice((f"{num(4)}-{num(2)}-{num(2)}", f"{num(6)}", f"{num(8)}", f"{num(5)} {num(5)}", f"{num(2)}.{num(2)}.{num(4)}", f"{num(3)}.{num(3)}", f"{num(20)}", f"{word()}{num(10)}{word()}", f"{num(1)}.{num(1)}.{num(2)}-{num(3)}", f"{num(4)} {num(4)} {num(4)}", f"1{num(3)}/{num(4)}", f"{num(3)}-{num(9)}")), None, ""

    keys = {"card": ("card", "visa", "credit"), "phone": ("call", "phone", "tel"), "email": ("email", "contact", "mail"), "ip": ("ip", "server", "host"), "iban": ("iban", "account"), "secret": ("token", "secret", "api_key", "password", "key", "bearer", "TOKEN")}
    out = []
    for _ in range(n):
        text, gold = " ".join(word() for _ in range(rng.randint(1, 4))), []
        for _ in range(rng.randint(1, 2)):
            own, k, kind = made()
            if kind == "secret":
                text += f" {rng.choice(keys[kind])}{rng.choice((' = ', '=', ': ', ' '))}{(quote := rng.choice(('', '\"', '\"', chr(39))))}"
            else:
                quote = ""
                if k is not None and rng.random() < 0.4:
                    text += f" {rng.choice(keys[kind])}{rng.choice((':', ''))}"
                text += rng.choice((" ", " ", "\n"))
            if k is not None:
                gold.append((len(text), len(text) + len(own), k))
            text += own + quote + rng.choice((" ", ". ", ", ", " ", "!! ")) + " ".join(word() for _ in range(rng.randint(0, 3)))
        tokens = _TOKEN.findall(text)
        places = np.concatenate(([0], np.cumsum([len(t) for t in tokens])))
        at = {int(p): i for i, p in enumerate(places)}
        out.append((tokens, {(at[a], at[b], k) for a, b, k in gold if a in at and b in at}))
    return out


@functools.lru_cache(1)
def fitted() -> SemiCrf:
    return SemiCrf().fit(made_sentences())


def added_spans(model: SemiCrf, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out: list[tuple[int, int, int]] = []
    for a, b, first, last in _near(text):
        if any(s <= first and last <= e for s, e, _ in base):
            continue  # nothing but a base span drew attention
        tokens = _TOKEN.findall(text[a:b])
        places = np.concatenate(([0], np.cumsum([len(t) for t in tokens]))) + a
        for s, e, k, p in model.decode(tokens):
            x, y = int(places[s]), int(places[e])
            if p >= LEAST_PROBABILITY and not any(u < y and x < v for u, v, _ in base) and not any(u < y and x < v for u, v, _ in out):
                out.append((x, y, k))
    return out


FOUND = T.StructType([
    *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:BASE_KINDS]), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
    *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS[BASE_KINDS:]), T.StructField("n_added", T.LongType()), T.StructField("n_spans", T.LongType()),
])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2])))


def finder(model: SemiCrf):
    """A column function: text to a struct. n_email, n_ip, n_card and n_phone count base spans; n_secret and n_iban, which have none, and
    n_added count the model's; n_spans counts all."""

    @F.pandas_udf(FOUND)
    def find(text: pd.Series) -> pd.DataFrame:
        rows = []
        for t in text:
            t = t or ""
            base = base_spans(t)
            added = added_spans(model, t, base)
            n = [sum(k == i for _, _, k in (base if i < BASE_KINDS else added)) for i in range(len(KINDS))]
            rows.append((*n[:BASE_KINDS], hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), *n[BASE_KINDS:], len(added), len(base) + len(added)))
        return pd.DataFrame(rows, columns=[f.name for f in FOUND])

    return find


def op2_personal_data(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", finder(fitted())(F.col("text").cast("string")).alias("found")).select("doc_id", "found.*")
