"""Operator 10: personal data by a semi-Markov conditional random field.

Base rules (fixed patterns of four kinds) are found everywhere and always stay. Beside them a
semi-Markov CRF reads the text's parts around digits and at-signs, wide enough for every segment there and its cue, so
that it finds what it would over the whole text: it cuts a window into units (runs of letters or digits, or single signs), scores every candidate segment of at most `MAX_CHARS` characters or `MAX_UNITS` units as a
whole (its shape, digits, check sum, the word before it, what its borders cut), and a Viterbi pass over
units chooses borders and kinds together. Bounded segments keep the pass linear in the text.

The weights are the CRF's maximum-likelihood fit, by gradient steps with the forward-backward
sums, on generated examples (seeded, the same in every process); nothing of the tables is learned.

Defined results: null and empty texts have no span; repeated rows and null ids give a row each; an
empty table gives none; columns beyond the named two are ignored. Offsets are code points, end
exclusive. A CRF span that overlaps a base span, of any kind, gives way to it.
"""

from __future__ import annotations

import hashlib
import math
import random
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import append_columns, fresh_names, map_rows, text_of

# The base kinds in their order, and what their patterns are made of.
BASE_KINDS = ["email", "ip", "card", "phone"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
CARD = r"[0-9](?:[ -]?[0-9])+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"

KINDS = [*BASE_KINDS, "secret"]
#: A segment is within one of the two: hex and code have up to 64 units of a character each, emails and numbers few long ones.
MAX_UNITS, MAX_CHARS = 24, 64
#: A segment's cue is the last one among so many units before it.
CUE_UNITS = 7


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base rules' spans, in that order."""
    found: list[tuple[int, int, int]] = []
    if "@" in text:
        # A local part is a maximal run before its at-sign, so each at-sign is looked at once.
        done, at, domain = 0, text.find("@"), re.compile(DOMAIN)
        while at >= 0:
            begin = at
            while begin > done and text[begin - 1] in LOCAL:
                begin -= 1
            m = domain.match(text, at + 1) if begin < at else None
            if m:
                found.append((begin, 0, m.end()))
                done = m.end()
            done = max(done, at + 1)
            at = text.find("@", done)
    if re.search("[0-9]", text):
        for m in re.finditer(IP, text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in re.finditer(CARD, text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in re.finditer(PHONE, text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


# --- the semi-Markov CRF ---------------------------------------------------------------------

UNIT = r"[^\W\d_]+|[0-9]+|[^\s]"
SHAPES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "quad": r"[0-9]{1,3}(\.[0-9]{1,3}){3}",
    "groups": r"[0-9]{3,6}([ .-][0-9]{3,6}){2,4}",
    "digits": r"[0-9]{12,19}",
    "plus": r"\+[0-9][ ().0-9-]{7,22}[0-9]",
    "area": r"\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}",
    "three three four": r"(\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[.-])[0-9]{3}[.-][0-9]{4}",
    "hex": r"[0-9a-fA-F]{20,64}",
    "code": r"[A-Za-z0-9_-]{16,64}",
    "base64": r"(?=.*[+/=])[A-Za-z0-9+/]{20,64}={0,2}",
    "date": r"[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}",
    "number": r"[0-9]+([.,][0-9]+)?",
}
#: What units of any shape are made of.
SHAPED = re.compile(r"[A-Za-z0-9@._%+(),/=-]+")
#: Words that announce a kind.
CUES = {"token": "secret", "secret": "secret", "key": "secret", "apikey": "secret", "password": "secret", "passwd": "secret", "bearer": "secret", "tel": "phone", "phone": "phone", "call": "phone", "fax": "phone", "mobile": "phone", "card": "card", "visa": "card", "ip": "ip", "host": "ip", "mail": "email", "email": "email"}
#: The same in scripts without blanks, found inside a run of letters.
INNER_CUES = {"电话": "phone", "手机": "phone", "致电": "phone", "電話": "phone", "密码": "secret", "密钥": "secret", "令牌": "secret", "パスワード": "secret", "邮箱": "email", "卡号": "card", "전화": "phone"}
#: From here on scripts have letters that stand beside digits without a blank.
UNSPACED = "\u2e80"


def joined(beside: str) -> bool:
    """Does what stands beside a border (read away from it) go on with the same thing?"""
    goes_on = lambda c: c.isalnum() and c < UNSPACED
    return goes_on(beside[:1]) or len(beside) > 1 and beside[0] in ".@-+_" and goes_on(beside[1])


def texture(span: str) -> str:
    """How many of lower, upper and digit a span has, and the signs of a random string: classes that change often, digits here and there."""
    classes = ["d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "s" for c in span]
    pairs = list(zip(["s", *classes], classes, strict=False))
    changes, digits = sum(x != y for x, y in pairs[1:]), sum(x != y == "d" for x, y in pairs)
    return f"texture={len(set(classes) - {'s'})}{'+' * (2 * changes > len(span))}{'+' * (digits > 2)}"


class SegmentCRF:
    """Weights by (feature, kind); score of a segment = sum over its features. Kind -1 is "none", one unit long."""

    def __init__(self, weights: dict[tuple[str, int], float] | None = None) -> None:
        self.weights = {} if weights is None else weights
        self.shapes = {k: re.compile(v) for k, v in SHAPES.items()}
        self.unit = re.compile(UNIT)
        self.known: dict[tuple, tuple] = {}
        self.worth: dict[tuple, list[tuple[int, float]]] = {}

    def units(self, text: str, low: int, high: int) -> list[tuple[int, int]]:
        return [m.span() for m in self.unit.finditer(text, low, high)]

    def features(self, span: str, cue: str, cut: bool) -> tuple[str, ...]:
        """Of a whole span; cut: a sign follows with which a path or a key goes on."""
        if len(span) > 64 + 2 or span.isalnum() and span.isascii() and not span.isdigit() and not 16 <= len(span) <= 64:
            span = ""  # no shape is such
        key = (span, cue, cut)
        got = self.known.get(key)
        if got is None:
            shape = [k for k, r in self.shapes.items() if r.fullmatch(span)]
            digits = "".join([c for c in span if c.isdigit()])
            names = ["bias", *shape, f"cue={cue}", f"goes on={cut}"]
            if "quad" in shape:
                names.append(f"parts={all(int(p) <= 255 for p in span.split('.'))}")
            if 12 <= len(digits) <= 19 and ("digits" in shape or "groups" in shape):
                names.append(f"luhn={luhn(digits)}")
            if "hex" in shape or "code" in shape or "base64" in shape:
                names.append(f"mixed={bool(digits) and len(digits) < len(span)}")
                names.append(f"cued={cue == 'secret'}")
                names.append(f"hex={'hex' in shape} {texture(span)}")
            if "plus" in shape or "area" in shape:
                names.append(f"phone digits={9 <= len(digits) <= 15}")
            if not shape:
                names.append("no shape")
            got = self.known[key] = tuple(names)
            if len(self.known) > 20_000:
                self.known.clear()
        return got

    def candidates(self, text: str, units: list[tuple[int, int]]) -> list[list[tuple[int, tuple[str, ...]]]]:
        """For each unit where a segment may end (exclusive): (first unit, features); only spans with a shape."""
        found: list[list[tuple[int, tuple[str, ...]]]] = [[] for _ in range(len(units) + 1)]
        # From each unit on, the next with a digit or an at-sign, which every shape needs, and the next that is in no shape.
        n = len(units)
        needed, foreign = [n] * (n + 1), [n] * (n + 1)
        for i in range(n - 1, -1, -1):
            unit = text[units[i][0] : units[i][1]]
            needed[i] = i if unit[0] in "0123456789@" else needed[i + 1]
            foreign[i] = foreign[i + 1] if SHAPED.fullmatch(unit) else i
        # A segment begins and ends where the text doesn't go on with the same thing, so an unbroken run has one segment at most.
        closed = [not joined(text[b : b + 2]) and (text[b - 1].isalnum() or text[b - 1] == "=") for _, b in units]
        cue, since = "", 0
        for i, (a, stop) in enumerate(units):
            word = text[a:stop].lower()
            first = text[a]
            if (first.isalnum() or first in "+(") and needed[i] < foreign[i] and not joined(text[max(0, a - 2) : a][::-1]):
                commas = 0
                for j in range(i + 1, foreign[i] + 1):
                    begin, b = units[j - 1]
                    if b - a > MAX_CHARS and j - i > MAX_UNITS:
                        break
                    if j > i + 1 and begin - units[j - 2][1] > 1:
                        break  # more than one blank: another field
                    commas += text[begin] == ","
                    if commas > 1:
                        break  # no shape has two
                    if j <= needed[i] or not closed[j - 1]:
                        continue
                    names = self.features(text[a:b], cue, text[b : b + 1] in ("/", "="))
                    if names[-1] != "no shape":
                        found[j].append((i, names))
            if first >= UNSPACED:
                inner = max(((word.rfind(c), c) for c in INNER_CUES), default=(-1, ""))
                if inner[0] >= max(0, len(word) - 8):
                    cue, since = INNER_CUES[inner[1]], i
            elif word in CUES:
                cue, since = CUES[word], i
            elif i - since >= CUE_UNITS:
                cue = ""
        return found

    def score(self, names: tuple[str, ...], kind: int) -> float:
        w = self.weights
        return sum([w.get((n, kind), 0.0) for n in names])

    def decode(self, text: str, low: int, high: int) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the best joint choice; ties keep "none", then the longer segment."""
        units = self.units(text, low, high)
        ends = self.candidates(text, units)
        worth = self.worth
        best, back = [0.0], [(-1, -1)]
        for j in range(1, len(units) + 1):
            top, how = best[j - 1], (j - 1, -1)
            for i, names in ends[j]:
                scores = worth.get(names)
                if scores is None:  # a segment of no positive score is never better than "none"
                    scores = worth[names] = [(k, w) for k in range(len(KINDS)) if (w := self.score(names, k)) > 0]
                for kind, w in scores:
                    s = best[i] + w
                    if s > top:
                        top, how = s, (i, kind)
            best.append(top)
            back.append(how)
        found, j = [], len(units)
        while j:
            i, kind = back[j]
            if kind >= 0:
                found.append((units[i][0], kind, units[j - 1][1]))
            j = i
        return found[::-1]

    def learn(self, examples: list[tuple[str, set[tuple[int, int, int]]]], epochs: int = 6, rate: float = 0.4, decay: float = 1e-3) -> None:
        """Stochastic gradient steps on the conditional log-likelihood of whole segmentations."""
        self.worth.clear()
        add = lambda x, y: (max(x, y) + math.log1p(math.exp(-abs(x - y)))) if x != -math.inf else y
        prepared = []
        for text, truth in examples:
            units = self.units(text, 0, len(text))
            prepared.append((text, units, self.candidates(text, units), truth))
        for epoch in range(epochs):
            step = rate / (1 + epoch)
            for _, units, ends, truth in prepared:
                n = len(units)
                segments = [(i, j, names, kind, self.score(names, kind)) for j in range(1, n + 1) for i, names in ends[j] for kind in range(len(KINDS))]
                into: list[list] = [[] for _ in range(n + 1)]
                out: list[list] = [[] for _ in range(n + 1)]
                for s in segments:
                    into[s[1]].append(s)
                    out[s[0]].append(s)
                forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
                for j in range(1, n + 1):
                    total = forward[j - 1]
                    for i, _, _, _, w in into[j]:
                        total = add(total, forward[i] + w)
                    forward[j] = total
                for i in range(n - 1, -1, -1):
                    total = backward[i + 1]
                    for _, j, _, _, w in out[i]:
                        total = add(total, backward[j] + w)
                    backward[i] = total
                for i, j, names, kind, w in segments:
                    p = math.exp(min(0.0, forward[i] + w + backward[j] - forward[n]))
                    gradient = ((units[i][0], kind, units[j - 1][1]) in truth) - p
                    if abs(gradient) > 1e-4:
                        for name in names:
                            old = self.weights.get((name, kind), 0.0)
                            self.weights[name, kind] = old + step * (gradient - decay * old)


def examples(n: int = 1600, seed: int = 7) -> list[tuple[str, set[tuple[int, int, int]]]]:
    """Generated lines with their true spans, and lines of look-alikes without any."""
    r = random.Random(seed)
    digits = lambda k: "".join([r.choice("0123456789") for _ in range(k)])
    word = lambda: "".join([r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9))])

    def card() -> str:
        body = str(r.randint(3, 6)) + digits(14)
        whole = next(body + d for d in "0123456789" if luhn(body + d))
        sign = r.choice(["", " ", "-", "."])
        return sign.join([whole[i : i + 4] for i in range(0, 16, 4)])

    made = {
        0: lambda: f"{word()}.{digits(2)}@{word()}{digits(1)}.{word()}.com",
        1: lambda: ".".join([str(r.randint(0, 255)) for _ in range(4)]),
        2: card,
        3: lambda: r.choice([f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}"]),
        4: lambda: r.choice([hexes, hexes, plain, plain, keyed, keyed, lambda: r.choice(["ghp_", "sk-", "tok_"]) + plain()])(),
    }
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    several = lambda of, *sizes: "".join([r.choice(of) for _ in range(r.choice(sizes))])
    hexes = lambda: several("0123456789abcdef", 24, 32, 40, 64)
    plain = lambda: several(letters + "0123456789", 24, 32, 40)

    def keyed() -> str:
        whole = several(letters + "0123456789+/", 32, 40, 43)
        at = r.randrange(8, 30)
        return whole[:at] + r.choice("+/") + whole[at + 1 : -1] + r.choice("abcXYZ019") + r.choice(["", "=", "=="])

    named = lambda: "".join([word().title() for _ in range(r.randint(2, 5))])
    cues = {0: ["mail", ""], 1: ["host", ""], 2: ["card", "", ""], 3: ["tel", "call", "phone", "", "电话", "请致电"], 4: ["token =", "secret =", "key:", "password =", "", "", "", "密钥"]}
    none = [lambda: f"{r.randint(1980, 2030)}-{r.randint(1, 12)}-{r.randint(1, 28)}", lambda: digits(r.randint(1, 9)), lambda: f"{digits(2)}.{digits(2)}", lambda: f"{r.randint(256, 999)}.{r.randint(256, 999)}.{r.randint(0, 99)}.{r.randint(0, 99)}", lambda: next(x for x in iter(lambda: digits(16), "") if not luhn(x)), lambda: "".join([r.choice("0123456789abcdef") for _ in range(32)]), lambda: f"{digits(1)}.{digits(1)}.{digits(1)}", lambda: "-".join([digits(4), digits(4), digits(2)])]
    none += [
        lambda: several("0123456789abcdef", 40), lambda: "-".join([several("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)]), lambda: f"{word()}{named()}{digits(2)}", lambda: "-".join([word(), word(), word(), word(), digits(4)]),
        lambda: f"IMG_{digits(8)}_{digits(6)}", lambda: f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", lambda: f"{word()}/{word()}{digits(1)}/{named()}/{word()}", lambda: f"{named()}/{digits(4)}/{digits(2)}/{word()}_{word()}",
        lambda: f"{digits(3)} {digits(3)} {digits(3)}", lambda: f"{word()}_{word()}_{word()}_{digits(3)}", lambda: f"{word()}={named()}{digits(2)}", lambda: f"ORD-{digits(4)}-{digits(6)}",
    ]
    out = []
    for i in range(n):
        text, truth = " ".join([word() for _ in range(r.randint(1, 4))]), set()
        for _ in range(r.randint(1, 2)):
            kind = i % 10 if i % 10 < 5 else -1
            if kind < 0:
                text += f" {r.choice(none)()} {word()}"
                continue
            cue, body = r.choice(cues[kind]), made[kind]()
            while not cue and kind == 4 and re.fullmatch("[0-9a-f]+", body):
                body = made[kind]()  # without a cue hex may be any digest
            quote = '"' if kind == 4 and r.random() < 0.8 else ""
            text += f" {quote}" if not cue else f" {cue}{quote}" if cue[0] >= UNSPACED else f" {cue} {quote}"
            truth.add((len(text), kind, len(text) + len(body)))
            text += f"{body}{quote}{r.choice(['', '.', ','])} {word()} {word()}"
        out.append((text, truth))
    return out


_MODEL: list[SegmentCRF] = []


def model() -> SegmentCRF:
    """The fitted CRF, fitted once in a process (a second or so)."""
    if not _MODEL:
        crf = SegmentCRF()
        crf.learn(examples())
        crf.known.clear()
        _MODEL.append(crf)
    return _MODEL[0]


def _class(c: str) -> int:
    """0 for white space, 1 and 2 for what runs on in a unit (letters, digits), 3 for a unit of its own."""
    return 0 if c.isspace() else 2 if "0" <= c <= "9" else 1 if c.isalnum() and not c.isdecimal() else 3


def _back(text: str, at: int, units: int, low: int) -> int:
    """Where the unit starts that is so many units before the border at; at low the walk ends."""
    while units and at > low:
        at -= 1
        kind = _class(text[at])
        if kind:
            units -= 1
            while kind < 3 and at > low and _class(text[at - 1]) == kind:
                at -= 1
    return at


def _on(text: str, at: int, units: int) -> int:
    """Where the unit ends that is so many units after the border at."""
    while units and at < len(text):
        kind = _class(text[at])
        at += 1
        if kind:
            units -= 1
            while kind < 3 and at < len(text) and _class(text[at]) == kind:
                at += 1
    return at


def windows(text: str) -> list[tuple[int, int]]:
    """Parts of the text around digits and at-signs, from border to border of units: with every segment and its cue whole.

    Walks back end at the window before, and walks on take a bounded number of units, so that the time is linear in the text.
    """
    out: list[tuple[int, int]] = []
    for m in re.finditer("[0-9]+|@", text):
        low = out[-1][1] if out else 0
        if m.end() + MAX_CHARS > low or _on(text, m.end(), MAX_UNITS) > low:
            # what lies before a border that cuts a unit is that unit's
            far = max(m.start() - MAX_CHARS, low)
            start = min(_back(text, m.start(), MAX_UNITS, low), _back(text, far, 1, low) if far > low else low)
            start = _back(text, start, CUE_UNITS, low)
            cut = min(m.end() + MAX_CHARS, len(text))
            end = max(_on(text, m.end(), MAX_UNITS), _on(text, cut, 1))
            if out and start <= low:
                out[-1] = (out[-1][0], max(end, low))
            else:
                out.append((start, end))
    return out


def spans_of(text: str, crf: SegmentCRF) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and all spans, as (start, kind number, end) in order."""
    base = base_spans(text)
    if not re.search("[0-9@]", text):
        return base, base
    own = [s for low, high in windows(text) for s in crf.decode(text, low, high)]
    taken = sorted((a, b) for a, _, b in base)
    extra = [(a, k, b) for a, k, b in own if not any(x < b and a < y for x, y in taken)] if len(taken) < 50 else _free(own, taken)
    return base, sorted(base + extra)


def _free(own: list[tuple[int, int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Those of own that overlap none of taken (both in order of start)."""
    import bisect

    reach, far = [], 0
    for _, b in taken:
        far = max(far, b)
        reach.append(far)
    starts = [a for a, _ in taken]
    return [(a, k, b) for a, k, b in own if not (n := bisect.bisect_left(starts, b)) or reach[n - 1] <= a]


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span (overlapping ones together) replaced by its first kind's name."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: counts and digest of the base spans, and all spans."""

    def make():
        crf = model()

        def fn(keys, texts):
            out = ([], [], [], [], [], [], [])
            for key, text in zip(keys, texts, strict=True):
                base, spans = spans_of(text_of(text), crf)
                counts = [sum(s[1] == k for s in base) for k in range(4)]
                for column, value in zip(out, (key, *counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)), strict=True):
                    column.append(value)
            return out

        return fn

    return map_rows(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), make, FOUND)


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with all found spans replaced by their kinds' names; null texts stay null, all rows stay."""

    def make():
        crf = model()
        return lambda texts: ([None if t is None else redact(t, spans_of(t, crf)[1]) for t in texts],)

    named, clean = fresh_names(docs, "text")
    return append_columns(named, text_col, make, f"{clean} string").withColumn(text_col, F.col(clean)).drop(clean)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
