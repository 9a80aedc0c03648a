"""Personal data: base patterns and a linear-chain conditional random field over word shapes.

The field is trained on a small labelled table that is part of this module, by gradient ascent on its likelihood, and
decoded by Viterbi in numpy batches over all words of a text. A word's score is the sum of what its own features, the two
words before it and the word after it say; these four vectors are made once for each distinct word. Where no run of other
labels can gain over `outside`, by a bound on what its words and transitions add, the best path is outside, so the chain
is cut there and only what lies between is searched: the labelling is that of the whole text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklore.llm.common import bounded_batches, table

# The patterns of the contract, in its order of kinds.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"  # matched in linear time by base_spans
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")  # a match can only start where digits start
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone", "secret", "account")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NON_DIGIT = re.compile(r"[^0-9]+")
Span = tuple[int, int, int]  # start, end, kind


def _luhn(digits: str) -> bool:
    twice = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (twice + sum(int(d) for d in digits[-1::-2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by start and kind."""
    out: list[Span] = []
    # at each at sign: the longest local part that starts after the last match and the last at sign, then a domain
    free, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > free and text[a - 1] in _LOCAL:
            a -= 1
        domain = _DOMAIN.match(text, at + 1) if a < at else None
        free = at + 1
        if domain:
            out.append((a, domain.end(), 0))
            free = domain.end()
        at = text.find("@", free)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), 1))
    for m in CARD.finditer(text):
        digits = _NON_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(_NON_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


# ---------------------------------------------------------------------------------------------------- the field

#: Forms of what is looked for. 9, x, h, A, a, N stand for a digit, a hex digit, one that is a letter, a capital, a small
#: letter, any letter or digit; {n} repeats what is before it, ~ ends a letter's meaning: ~a is the letter a.
FORMS = {
    "email": ["a{5}.a{6}@a{7}", "a{4}99@a{5}9", "a{4}@a{9}", "a{5}@a{4}", "a{5}.a{6}99@a{4}9.a{7}.a{3}", "a{4}.a{1}999@a{6}9.a{6}.a{2}", "a{8}999@a{5}9.a{3}", "A{1}a{4}.A{1}a{6}9@a{8}.a{3}", "a{6}@a{9}.~c~o~m", "A{1}a{5}_a{4}@a{6}.a{4}.a{2}", "a{3}[at]a{6}.a{3}", "<a{5}@a{8}.a{2}>", "mailto:a{6}@a{8}.a{3}"],
    "ip": ["99.999.9.99:9999", "999.99.99.999", "99.99.99.9/99", "xxxx:xxxx:xxxx::xxxx", "xxxx::xxxx:xxxx", "xxxx:xxx:xxxx::x", "xxxx:xxxx:xxxx:xxxx:xxxx:xxxx:xxxx:xxxx"],
    "card": ["9999 9999 9999 9999", "9999-9999-9999-9999", "9{16}", "9999 999999 99999", "9{15}"],
    "phone": ["(999) 999-9999", "999-999-9999", "999.999.9999", "+99 999 9999999", "+9-999-999-9999", "0999 9999999", "099 99 99 99 99", "1-999-999-9999", "099-999-9999", "+99 (9) 999 999 999", "999 999 9999"],
    "secret": [
        "x{32}", "x{40}", "x{64}", "x{16}", "h{32}", "h{20}", "h{40}", "N{20}", "N{24}", "N{36}", "N{48}", '"x{40}"', '"N{32}"', "A{4}N{16}", "AA9A9A9AA9A9AA9A9AA9", "AAAA{1}A{8}9A{4}9A", "a{2}_N{24}", "a{2}_a{4}_N{28}", "a{3}-N{32}", "A{3}_N{30}", "N{12}/N{10}+N{16}==",
        "xxxxxxxx-xxxx-xxxx-xxxx-xxxxxxxxxxxx", "N{20}.N{30}.N{40}", "KEY=N{9}", "KEY=a{9}", "KEY=x{18}", "KEY=x{20}", "KEY=N{20}", 'KEY="N{24}"', "KEY='a{6}99!'", "KEY:N{16}", "KEY=a{6}", "--KEY=N{12}", "KEY=x{32}",
    ],
    "account": ["AA99 9999 9999 9999 9999 99", "AA99AAAA99999999999999", "AA99 AAAA 9999 9999 9999 99"],
}
KEYS = "password passwd pass pwd token secret api_key apikey key access_key auth secret_key client_secret PASSWORD API_KEY TOKEN SECRET_KEY".split()
#: What stands around them; | marks the place. After the words of the last group any short word is a secret too.
AROUND = {
    "email": ["write to | or call", "mail |", "contact |, please", "reach me at | soon", "from: | to us", "my address is | for now", "|"],
    "ip": ["connect from | on port", "server | is down", "host | refused", "ping | failed", "at |", "client | sent it"],
    "card": ["card | was charged", "pay with | today", "number | on file", "credit card: |", "visa | expires", "|"],
    "phone": ["call | after noon", "phone | is mine", "ring | now", "tel. |", "dial | or", "my number is |", "mobile: |", "fax | at home", "Telefon | oder", "tél. | le soir", "llame al | hoy", "|"],
    "secret": ["the token = | is used", "use | for it", "key | leaked", "set | and go", "login | then", "export | first", "here: |", "header Bearer | sent", "a | was found", "|", "with | in the log", "run it with | now", "the | is new"],
    "account": ["account | at the bank", "IBAN | please", "transfer to | today", "iban: |"],
}
SAID = ["password is |", "my password: |", "the passphrase is |", "pin code |", "password = | works", "passwd: |", "the password was | before"]
SHORT = ["a{6}99", "a{8}", "Aa{5}9!", "9999", "a{4}_a{5}", "N{10}"]
#: Sentences without any. 9, x, A, a, N as above after a backquote.
CLEAN = [
    "Licensed under CC BY-NC `9.9. All rights", "Apache License Version `9.9 applies", "General Public License, version `9. The program", "in `9999 there were `99 of `9,999 people", "chapter `9 of `99 pages in `9999 words",
    "on `99 May `9999 at `99:99 the `9th time", "about `99% of `999999 rows and `9.99 each", "see section `9.9.9 and table `99 below", "model `a9 and `a9 paper with `a99 size", "price `99.99 or `999.99 euro in `9999-99-99",
    "scores `9 `99 `99 `99 `99 in a row", "table `9 `9 `9 `9 `9 `9 with `99 `999 `9999", "route `99 north and `a9 header `aa9 file", "ISBN `999-9-99-999999-9 is a book", "ISBN `9999999999 or `999-9999999999", "order `AAA-99999999-9999 was sent",
    "invoice `AA-9999-99999 of `99/99/9999", "ticket `AAAA-9999 is open", "part number `AA9999-99 fits", "version `9.99.9 of `aaaa-9.9.9 came", "commit on `9999-99-99T99:99:99Z", "the flight `AA9999 left at `99.99", "room `999A and `99B",
    "a very long unlikelihood of misunderstanding", "die Geschwindigkeitsbegrenzung und Straßenbahnhaltestelle", "l'électroencéphalogramme était là", "el otorrinolaringólogo llegó", "THE QUICK BROWN FOX JUMPS", "NASA and UNESCO said", "Mr. Brown met Mrs. Green",
    "see https://www.`aaaaaaa.com/`aaaa/`99/`aaaa?id=`99 there", "www.`aaaaaa.org/`aaaaa is down", "open /usr/local/lib/`aaaa.`aa now", "call foo_bar(`9, `99) here", "x = `99 and y=`9 or n=`999", "width=`999 height=`99", "a=b and key=value here", "if a == b then c != d",
    "word | word | `99 | `9", "### the *** and $$$ of %%% it", "`aaaaaa$$$ `aaaa%%% `aaaaa### `aaaa*** `aaa&&&", "`aaaa,### `aaaaa$$$ the&&&", "- [x] done <br> <b>bold</b> &nbsp; text", "`Aaaaaaaa `aaaaaa `aaa `aaaaaaaaa `aaaa, `aaaaa.", "`aaaa `aaaaaaaaaaaa `aa `aaaaaaaaaaaaaaa.",
    "`Aaaaaa, `aaa `aaaaaaa `aaaaaaaaaaaaaaaaaaa `aaaaa", "the password must be long", "your password, please", "a token of love and a secret garden", "the key to it is here", "press any key or the space bar", "the secret is to wait", "card games and phone calls", "an email is sent by mail",
    "population `9,999,999 in `9999", "`9 `9 `9", "`99 `99 `99 `99", "`999 `999 `999", "`9999 `9999", "total `99999999 bytes", "pi is `9.99999999999 or so", "id `99999999 row `9999999", "`99:99:99 up `99 days", "(`9) and [`99] or {`9}", "C++`99 and HTML`9", "`9x`9 and `99x`99 pixels", "no. `9999 of `999",
    "`aaaaöaaa `Aaaaßaa üaaaa `aaaaaéaaa èaaa `aaañaa", "`ñaaaa óaaaaa íaaa `aaçaa", "aaaaaaaaaaaaaaaa aaaa hahahahahahaha", "`aaaa-`aaaaa and `aaa-`aa-`aaa", "`aaaaaaaaaaaaaaaaaaaaaaaaaaaa or `Aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa, `aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "`aaaaa/`aaaa or `aaa's `aaaa", "and/or e.g. i.e. etc.", "$`99.99 or €`99 and £`9", "`99°C and `99kg, `99km/h", "@`aaaaaa and #`aaaaaa on the net",
]
VARIANTS, EPOCHS, SEED = 6, 70, 11
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
_RUN = re.compile(r"(.)\1+")
_FILL = {"9": "0123456789", "x": "0123456789abcdef", "h": "abcdef", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "a": "abcdefghijklmnopqrstuvwxyz", "N": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"}
EDGES = "\"'.,;:!?()[]<>{}"
_HEX = frozenset("0123456789abcdef-")


def shape(word: str) -> str:
    """A for capitals, a for small letters, 9 for digits, others as they are; runs shortened to one."""
    return _RUN.sub(r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word))


def word_features(word: str) -> list[str]:
    """What the field sees of a word itself: shape, composition, and what stands before an equals sign."""
    head, eq, rest = word.partition("=")
    if not eq or not rest or not re.fullmatch(r"[-\w.]+", head):
        head, rest = "", word
    core = rest.strip(EDGES)
    n = max(1, len(core))
    digits = sum(c.isdigit() for c in core)
    letters = sum(c.isalpha() for c in core)
    upper = sum(c.isupper() for c in core)
    kinds = ["9" if c.isdigit() else "A" if c.isupper() else "a" for c in core]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:]))
    size = "0-3" if n < 4 else "4-7" if n < 8 else "8-13" if n < 14 else "14-19" if n < 20 else "20-31" if n < 32 else "32+"
    hexed = n >= 16 and set(core) <= _HEX
    mixed = "no" if not (digits and letters) else "few" if turns < 4 else "many"
    whole = core.isalnum()
    low = core.lower()
    out = [
        f"shape={shape(core)}" if n <= 40 else "shape=long", f"frame={shape(word[:3])}{shape(word[-3:])}", f"size={size}", f"digits={min(digits, 20)}/{size}", f"hex={hexed}", f"mixed={mixed}/{size}/{whole}",
        f"upper={upper > 1 and 2 * upper > n}/{size}/{bool(digits)}", f"letters={letters == n}/{size}/{upper == n}", f"at={'@' in core[1:-1]}/{'.' in core.rpartition('@')[2]}", f"dots={min(core.count('.'), 4)}/{digits > 0}", f"colons={min(core.count(':'), 3)}/{digits > 0}",
        f"dashes={min(core.count('-'), 4)}/{digits > 0}", f"slashes={'/' in core}/{'://' in core}", f"word={low}" if letters == n and n < 14 else "word=",
    ]
    # a value after an equals sign is another matter than a word of the same shape
    key = head.strip("-").lower().rpartition("_")[2]
    return [f"={x}" for x in out[:-1]] + [f"key={key}", f"key={key}/{mixed}/{size}", "word="] if head else out


def near_features(word: str) -> list[str]:
    """What its neighbours see of a word."""
    core = word.strip(EDGES).lower()
    kind = "digits" if core.isdigit() else "word" if core.isalpha() else shape(core)[:1] + str(any(c.isdigit() for c in core))
    return [f"near={kind}/{min(len(core), 6)}", f"said={core}" if core.isalpha() and len(core) < 14 else "said=", f"end={word[-1:] if not word[-1:].isalnum() else ''}"]


def _table() -> list[tuple[list[str], list[int]]]:
    """Words and labels of the labelled table's variants."""
    rng = np.random.default_rng(SEED)
    pick = lambda x: x[rng.integers(len(x))]

    def value(form: str, key: str) -> str:
        def draw(m: re.Match[str]) -> str:
            if m[1]:
                return m[1]
            return "".join(pick(_FILL[m[2]]) for _ in range(int(m[3] or 1)))

        made = re.sub(r"~(.)|([9xhAaN])(?:\{(\d+)\})?", draw, form.replace("KEY", "\0").replace("mailto", "\1").replace("[at]", "\2"))
        return made.replace("\0", key).replace("\1", "mailto").replace("\2", "[at]")

    out = []
    filler = lambda: ["".join(pick(_FILL["a"]) for _ in range(rng.integers(2, 12))) for _ in range(rng.integers(0, 4))]

    def add(around: str, form: str, kind: str, key: str = "") -> None:
        before, _, after = around.partition("|")
        own = value(form, key).split(" ")
        words = [*filler(), *before.split(), *own]
        labels = [0] * (len(words) - len(own)) + [1 + 2 * KINDS.index(kind) + (i > 0) for i in range(len(own))]
        rest = [*after.split(), *filler()]
        if after.startswith(","):
            words[-1] += ","
            rest = rest[1:]
        out.append((words + rest, labels + [0] * len(rest)))

    for kind, forms in FORMS.items():
        for form in forms:
            for key in KEYS if "KEY" in form else [""] * VARIANTS:
                add(pick(AROUND[kind]), form, kind, key)
    for form in SHORT:
        for around in SAID:
            add(around, form, "secret")
    for line in CLEAN:
        for _ in range(VARIANTS):
            words = " ".join([*filler(), re.sub(r"`([^ ]*)", lambda m: "".join(pick(_FILL[c]) if c in _FILL else c for c in m[1]), line), *filler()]).split()
            out.append((words, [0] * len(words)))
    return out


class _Classes(dict):
    """Character classes by code point, for str.translate: as in `shape`."""

    def __missing__(self, c: int) -> str:
        out = self[c] = shape(chr(c))
        return out


_CLASSES = _Classes()
#: Distinct words whose vectors a worker remembers, and their characters.
MOST_KNOWN, MOST_KNOWN_CHARS = 300_000, 1 << 24


class _Rows(dict):
    """Row numbers of words, made when first asked for."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make, self.chars = make, 0

    def __missing__(self, word: str) -> int:
        k = self[word] = self.make(word)
        self.chars += len(word)
        return k


class Field:
    """Emission weights by feature, transition weights, and Viterbi over batches of runs."""

    #: Vectors of a word: for itself, for the word after it, for the one after that, and for the word before it.
    VIEWS = ("own", "after", "second", "before")

    def __init__(self, table: list[tuple[list[str], list[int]]] | None = None) -> None:
        self.index: dict[str, int] = {}
        n = len(_LABELS)
        self.bad = np.zeros((n + 1, n), bool)  # the last row is the start; I- only after B- or I- of its kind
        for j, y in enumerate(_LABELS):
            if y[0] == "I":
                for i in range(n + 1):
                    self.bad[i, j] = i == n or _LABELS[i][2:] != y[2:]
        self._train(_table() if table is None else table)
        self.move = np.where(self.bad, -1e9, self.move)
        # most that a run of other labels may gain over O by its transitions: inside, for each word, and at its ends
        base = self.move[0, 0]
        self.inner = float(self.move[1:n, 1:].max() - base)
        self.ends = float(max(self.move[0, 1:].max() - base, self.move[n, 1:].max() - self.move[n, 0]) + max(0.0, self.move[1:n, 0].max() - base) - self.inner)
        self.named = {w: i for w in {f.partition("=")[2] for f in self.index if ":word=" in f or ":said=" in f} - {""} for i in [np.zeros((len(self.VIEWS), n), np.float32)]}
        for w, rows in self.named.items():
            for v, view in enumerate(self.VIEWS):
                rows[v] += self._sum(view, [f"said={w}" if v else f"word={w}"])
        self._forget()

    def _forget(self) -> None:
        self.known = _Rows(self._vectors)
        self.alike: dict[tuple, np.ndarray] = {}
        self.rows = np.zeros((4096, len(self.VIEWS), len(_LABELS)), np.float32)
        # row 0 stands between texts: outside for certain, and no word to its neighbours
        self.rows[0, 0, 1:] = -1e6
        for v, view in enumerate(self.VIEWS):
            self.rows[0, v] += 0 if not v else self._sum(view, ["none"])

    def names(self, words: list[str], i: int) -> list[str]:
        out = [f"own:{f}" for f in word_features(words[i])]
        for view, j in (("after", i - 1), ("second", i - 2), ("before", i + 1)):
            out += [f"{view}:{f}" for f in (near_features(words[j]) if 0 <= j < len(words) else ["none"])]
        return out

    def _train(self, data: list[tuple[list[str], list[int]]]) -> None:
        n, longest = len(_LABELS), max(len(w) for w, _ in data)
        feats, at = [], []
        for k, (words, _) in enumerate(data):
            for i in range(len(words)):
                ids = [self.index.setdefault(f, len(self.index)) for f in self.names(words, i)]
                feats += ids
                at += [k * longest + i] * len(ids)
        order = np.argsort(feats, kind="stable")
        feats, at = np.array(feats)[order], np.array(at)[order]
        starts = np.flatnonzero(np.concatenate(([True], feats[1:] != feats[:-1])))
        size = np.array([len(w) for w, _ in data])
        gold = np.zeros((len(data), longest), int)
        for k, (_, ys) in enumerate(data):
            gold[k, : len(ys)] = ys
        live = np.arange(longest) < size[:, None]
        seen_e = np.zeros((len(data), longest, n))
        seen_e[np.nonzero(live) + (gold[live],)] = 1
        seen_m = np.zeros((n + 1, n))
        np.add.at(seen_m, (np.full(len(data), n), gold[:, 0]), 1)
        np.add.at(seen_m, (gold[:, :-1][live[:, 1:]], gold[:, 1:][live[:, 1:]]), 1)
        self.emit, self.move = np.zeros((len(self.index), n)), np.zeros((n + 1, n))
        sums_e, sums_m = np.full_like(self.emit, 1e-8), np.full_like(self.move, 1e-8)
        by_word = np.argsort(at, kind="stable")
        w_starts = np.flatnonzero(np.concatenate(([True], np.diff(at[by_word]) > 0)))
        for _ in range(EPOCHS):
            em = np.zeros((len(data) * longest, n))
            em[at[by_word][w_starts]] = np.add.reduceat(self.emit[feats[by_word]], w_starts, axis=0)
            p, moved = self._expected(em.reshape(len(data), longest, n), size, live)
            resid = (seen_e - p).reshape(-1, n)
            grad_e = np.add.reduceat(resid[at], starts, axis=0) - 0.03 * self.emit
            grad_m = seen_m - moved - 0.03 * self.move
            sums_e += grad_e**2
            sums_m += grad_m**2
            self.emit += 0.4 * grad_e / np.sqrt(sums_e)
            self.move += 0.4 * grad_m / np.sqrt(sums_m)

    def _expected(self, em: np.ndarray, size: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of each word's labels, and expected counts of transitions, by forward and backward sums."""
        n, longest = em.shape[2], em.shape[1]
        step, start = np.where(self.bad[:n], 0.0, np.exp(self.move[:n])), np.where(self.bad[n], 0.0, np.exp(self.move[n]))
        e = np.exp(em - em.max(axis=2, keepdims=True))
        one = lambda x: x / x.sum(axis=1, keepdims=True)  # noqa: E731  all but proportions cancel out
        fore, back = np.zeros_like(em), np.ones_like(em)
        fore[:, 0] = one(start * e[:, 0])
        for t in range(1, longest):
            fore[:, t] = np.where(live[:, t, None], one((fore[:, t - 1] @ step) * e[:, t]), fore[:, t - 1])
        for t in range(longest - 2, -1, -1):
            back[:, t] = np.where(live[:, t + 1, None], one((e[:, t + 1] * back[:, t + 1]) @ step.T), 1.0)
        p = fore * back
        p = np.where(live[:, :, None], p / p.sum(axis=2, keepdims=True), 0.0)
        moved = np.zeros((n + 1, n))
        moved[n] = p[:, 0].sum(axis=0)
        for t in range(1, longest):
            a, b = fore[live[:, t], t - 1], (e[:, t] * back[:, t])[live[:, t]]
            moved[:n] += step * ((a / ((a @ step) * b).sum(axis=1, keepdims=True)).T @ b)
        return p, moved

    def _sum(self, view: str, names: list[str]) -> np.ndarray:
        ids = [i for f in names if (i := self.index.get(f"{view}:{f}")) is not None]
        return self.emit[ids].sum(axis=0)

    def _vectors(self, word: str) -> int:
        """Number of a word's row of vectors. Words with the same classes of characters share what their letters do not change."""
        core = word.strip(EDGES)
        key = word.translate(_CLASSES), len(core) >= 16 and set(core) <= _HEX, word.partition("=")[0] if "=" in word else ""
        row = self.alike.get(key)
        if row is None:
            own, near = ([f for f in names if not f.startswith(("word=", "said="))] for names in (word_features(word), near_features(word)))
            row = self.alike[key] = np.stack([self._sum(view, [*(near if v else own), "said=" if v else "word="]) if not core.isalpha() or len(core) > 13 else self._sum(view, near if v else own) for v, view in enumerate(self.VIEWS)]).astype(np.float32)
        k = len(self.known) + 1
        if k == len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
        self.rows[k] = row
        if len(core) < 14 and (more := self.named.get(core.lower())) is not None and core.isalpha():
            self.rows[k] += more
        return k

    def scores(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Emission scores of all words of some texts in a row, and where each text begins; two rows between texts, and before
        the first and after the last, are outside. Vectors of distinct words are remembered up to a number of words."""
        if len(self.known) > MOST_KNOWN or self.known.chars > MOST_KNOWN_CHARS:
            self._forget()
        ids = np.zeros(2 + sum(len(own) + 2 for own in words), np.int64)
        begin, at = np.zeros(len(words), np.int64), 2
        for k, own in enumerate(words):
            begin[k] = at
            ids[at : at + len(own)] = list(map(self.known.__getitem__, own))
            at += len(own) + 2
        em = self.rows[ids, 0]
        em[1:] += self.rows[ids[:-1], 1]
        em[2:] += self.rows[ids[:-2], 2]
        em[:-1] += self.rows[ids[1:], 3]
        return em, begin

    def label(self, words: list[list[str]]) -> list[list[tuple[int, list[int]]]]:
        """(first word, labels) of the runs of each text that may hold anything; all other words are O."""
        out: list[list[tuple[int, list[int]]]] = [[] for _ in words]
        first = 0
        while first < len(words):  # some tens of thousands of words at once
            last, n = first + 1, len(words[first])
            while last < len(words) and n + len(words[last]) < 50_000:
                n += len(words[last])
                last += 1
            em, begin = self.scores(words[first:last])
            # x: most that a word can add to a run of other labels; a word may be in one if some run around it gains
            x = em[:, 1:].max(axis=1).astype(np.float64) - em[:, 0] + self.inner
            upto = np.concatenate(([0.0], np.cumsum(x)))
            left = upto[1:] - np.minimum.accumulate(upto[:-1])
            right = np.maximum.accumulate(upto[:0:-1])[::-1] - upto[:-1]
            turn = np.flatnonzero(np.diff(left + right - x + self.ends >= -1e-3, prepend=False, append=False))
            starts, stops = turn[::2], turn[1::2]
            whose = np.searchsorted(begin, starts, side="right") - 1
            size = np.array([len(w) for w in words[first:last]])
            runs = [(em[a:z], a == begin[k], z == begin[k] + size[k]) for a, z, k in zip(starts, stops, whose)]
            for k, a, ys in zip(whose.tolist(), starts.tolist(), self.decode(runs)):
                out[first + k].append((a - int(begin[k]), ys))
            first = last
        return out

    def decode(self, runs: list[tuple[np.ndarray, bool, bool]]) -> list[list[int]]:
        """Best labels of each run (scores, whether it begins its text, whether it ends it); an O stands before and after it
        otherwise. Runs of equal length are one numpy batch."""
        n = len(_LABELS)
        out: list[list[int]] = [[] for _ in runs]
        by_len: dict[int, list[int]] = {}
        for i, r in enumerate(runs):
            by_len.setdefault(len(r[0]), []).append(i)
        for size, who in by_len.items():
            step = max(1, 20_000 // size)
            for k in range(0, len(who), step):
                part = who[k : k + step]
                em = np.stack([runs[i][0] for i in part])
                first, last = (np.array([runs[i][j] for i in part]) for j in (1, 2))
                best = np.where(first[:, None], self.move[n], self.move[0]) + em[:, 0]
                back = np.zeros((size, len(part), n), np.int8)
                for t in range(1, size):
                    via = best[:, :, None] + self.move[None, :n]
                    back[t] = via.argmax(axis=1)
                    best = via.max(axis=1) + em[:, t]
                y = (best + np.where(last[:, None], 0.0, self.move[:n, 0])).argmax(axis=1)
                path = [y]
                for t in range(size - 1, 0, -1):
                    y = back[t][np.arange(len(part)), y]
                    path.append(y)
                for i, ys in zip(part, np.stack(path[::-1], axis=1).tolist()):
                    out[i] = ys
        return out


@lru_cache(maxsize=1)
def field() -> Field:
    return Field()


def crf_spans(texts: list[str], f: Field) -> list[list[Span]]:
    """Spans that the field finds in each text, without quotes and punctuation around them and what an equals sign names."""
    words = [_TOKEN.findall(t) for t in texts]
    out: list[list[Span]] = [[] for _ in texts]
    for k, runs in enumerate(f.label(words)):
        runs = [(a, ys) for a, ys in runs if any(ys)]
        if not runs:
            continue
        places = [m.span() for m in _TOKEN.finditer(texts[k])]
        for first, ys in runs:
            i = 0
            while i < len(ys):
                if not ys[i]:
                    i += 1
                    continue
                j = i + 1
                while j < len(ys) and ys[j] and ys[j] % 2 == 0:
                    j += 1
                a, z = places[first + i][0], places[first + j - 1][1]
                head = re.match(r"[-\w.]+[=:](?=.)", texts[k][a:z]) if _LABELS[ys[i]] == "B-secret" else None
                a += head.end() if head else 0
                while a < z and texts[k][a] in EDGES and (texts[k][a] != "(" or ")" not in texts[k][a:z]):
                    a += 1
                while a < z and texts[k][z - 1] in EDGES:
                    z -= 1
                kind = (ys[i] - 1) // 2
                if a < z and (KINDS[kind] != "card" or _luhn(_NON_DIGIT.sub("", texts[k][a:z]))):  # another number is no card
                    out[k].append((a, z, kind))
                i = j
    return out


def find(texts: list[str | None], f: Field) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text: the field's spans are added where they overlap no base span."""
    plain = [t or "" for t in texts]
    out = []
    for base, more in zip(map(base_spans, plain), crf_spans(plain, f)):
        extra = [s for s in more if not any(a < s[1] and s[0] < z for a, z, _ in base)]
        out.append((base, sorted({*base, *extra}, key=lambda s: (s[0], s[2], s[1]))))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, z, k in spans)


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: `<id_col>`, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_spans.

    Null text counts as empty and has no spans. Offsets are code points, ends exclusive. Of equally good labellings the one
    whose labels come first is taken; repeated rows give repeated results; an empty table gives an empty one. Very long
    texts and words are read whole, in time linear in their length. Extra columns are ignored, whatever their names."""
    bounded_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(field())
    kind = dict(df.dtypes)[id_col]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = find(b.column(1).to_pylist(), held.value)
            cols = [pa.array([sum(s[2] == k for s in base) for base, _ in got], pa.int64()) for k in range(4)]
            cols += [pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in got], pa.string())]
            cols += [pa.array([written(every) for _, every in got], pa.string()), pa.array([len(every) for _, every in got], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], [id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    schema = f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"
    return df.select(id_col, F.col(text_col).cast("string").alias("_t")).mapInArrow(scan, schema)


def masked(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df` with each span of `<text_col>` replaced by <kind>; overlapping spans are one replacement, by the first's kind."""
    bounded_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(field())
    names = df.columns

    def cut(text: str | None, spans: list[Span]) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for a, z, k in spans:
            if a >= at:
                out += [text[at:a], f"<{KINDS[k]}>"]
            at = max(at, z)
        return "".join(out) + text[at:]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i = names.index(text_col)
        for b in batches:
            texts = b.column(i).to_pylist()
            new = [cut(t, every) for t, (_, every) in zip(texts, find(texts, held.value))]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == i else b.column(c) for c in range(len(names))], names)

    return df.mapInArrow(scan, df.schema)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
