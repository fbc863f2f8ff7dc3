"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns give the base spans, which always stay. The random field looks at whole candidate segments around digits
and at-signs: features of the segment score every (segment, kind), and one dynamic programme per region, with segments
of bounded length, chooses boundaries and kinds jointly against leaving the text alone. It is trained on regions of a
bounded sample of the documents, whose base spans are the truth, together with rewritten forms of personal data that
the patterns do not know (other separators, spelt-out signs), placed into the same contexts.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import sliced, texts

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
#: A match that starts inside a run of digits would only repeat one that starts at its first digit.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
MARK = re.compile(r"[0-9@]|[(\[{<]\x20?(?i:at)\x20?[)\]}>]")
SPOKEN = re.compile(r"\b(?i:at)\b[^\n]{1,40}?\b(?i:dot)\b")
TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|\s+|.", re.S)
#: What may follow an at-sign, in any spelling.
FOLLOWS = re.compile(r"\x20?[A-Za-z0-9-]++(?:\x20?(?:[(\[{<]\x20?(?:(?i:dot)|\.)\x20?[)\]}>]|\.|(?<=\x20)(?i:dot)(?=\x20))\x20?[A-Za-z0-9-]++)+")
AROUND, MOST_TOKENS = 40, 32
#: Tokens per step of the dynamic programme, and tokens on both sides of which no segment of the step goes beyond.
STEP, BESIDE = 2_048, 64


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d)
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the fixed patterns: per kind leftmost and non-overlapping, failing matches dropped."""
    out = []
    after = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            out.append(("email", start, found.end()))
        after = found.end() if found else at
        at = text.find("@", max(at + 1, after))
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def regions(text: str) -> list[tuple[int, int]]:
    """Parts of the text around digits and at-signs, chained as long as their surroundings touch; parts do not overlap.

    Around an at-sign the whole local part and all that may be its domain belong to the part.
    """
    marks = [(m.start(), m.end()) for m in MARK.finditer(text)]
    if " dot " in text or " DOT " in text or " Dot " in text:
        marks = sorted(marks + [(m.start(), m.end()) for m in SPOKEN.finditer(text)])
    out: list[list[int]] = []
    for a, b in marks:
        low, high = max(a - AROUND, 0), min(b + AROUND, len(text))
        if not text[a].isdigit():
            start = a - (text[a - 1 : a] == " ")
            while start > 0 and text[start - 1] in LOCAL:
                start -= 1
            # `b` of a spoken address is behind its first dot
            sign = a + 2 if text[a] in "aA" else b
            follows = FOLLOWS.match(text, sign)
            low, high = min(low, max(start - 2, 0)), max(high, min(follows.end() + 2, len(text)) if follows else high)
        while out and low <= out[-1][1]:
            first, end = out.pop()
            low, high = min(low, first), max(high, end)
        out.append([low, high])
    return [(a, b) for a, b in out if a < b]


# ---------------------------------------------------------------- segments and features


def _is_at(tokens: list[str], k: int) -> int:
    """Tokens that an at-sign takes from `k` on; 0 if there is none: @, (at), [ at ], or the word between blanks."""
    t = tokens[k]
    if t == "@":
        return 1
    if t in "([{<":
        for n in (3, 5):
            part = [x for x in tokens[k : k + n] if x != " "]
            if len(part) == 3 and part[1].lower() == "at" and part[2] in ")]}>":
                return n
    return int(t.lower() == "at" and 0 < k < len(tokens) - 1 and tokens[k - 1] == " " and tokens[k + 1] == " ")


def _is_dot(tokens: list[str], k: int) -> int:
    t = tokens[k]
    if t == ".":
        return 1
    if t in "([{<":
        for n in (3, 5):
            part = [x for x in tokens[k : k + n] if x != " "]
            if len(part) == 3 and part[1].lower() in ("dot", ".") and part[2] in ")]}>":
                return n
    return int(t.lower() == "dot" and 0 < k < len(tokens) - 1 and tokens[k - 1] == " " and tokens[k + 1] == " ")


def candidates(tokens: list[str]) -> list[tuple[int, int, bool]]:
    """(start, end, numeric) of the segments that may be personal data, at most MOST_TOKENS tokens long."""
    out, n = [], len(tokens)
    for i in range(n):
        if not (tokens[i].isascii() and (tokens[i].isdigit() or tokens[i] in "+(")):
            continue
        digits = 0
        for j in range(i, min(n, i + MOST_TOKENS)):
            t = tokens[j]
            if t.isascii() and t.isdigit():
                digits += len(t)
                if digits > 19:
                    break
                if digits >= 4:
                    out.append((i, j + 1, True))
            elif t.isalpha() and t.lower() != "dot" or "\n" in t or (t.isspace() and len(t) > 1) or t in ",;:@=\"'!?":
                break
    for k in range(n):
        width = _is_at(tokens, k)
        if not width:
            continue
        blank = int(k > 0 and tokens[k - 1] == " ")
        starts, i = [], k - blank - 1
        while i >= 0 and k - i <= 10 and (tokens[i].isascii() and tokens[i].isalnum() or tokens[i] in "._%+-"):
            if tokens[i].isalnum():
                starts.append(i)
            i -= 1
        j, dots, just = k + width, 0, True
        while j < n and j - k <= MOST_TOKENS - 10:
            size = _is_dot(tokens, j)
            if size and not just:
                dots, just, j = dots + 1, True, j + size
            elif tokens[j] == " " and (just or j + 1 < n and _is_dot(tokens, j + 1)):
                j += 1
            elif tokens[j].isascii() and tokens[j].isalnum() or tokens[j] == "-":
                if not just and tokens[j - 1] == " ":
                    break
                just, j = False, j + 1
                if dots:
                    out += [(s, j, False) for s in starts]
            else:
                break
    return out


def features(tokens: list[str], i: int, j: int, numeric: bool) -> list[str]:
    """Whole-span features: shape, separators, checks and the characters on both sides."""
    part = tokens[i:j]
    before = tokens[i - 1] if i else "^"
    after = tokens[j] if j < len(tokens) else "$"
    beyond = tokens[j + 1] if j + 1 < len(tokens) else "$"
    out = ["bias"]
    if numeric:
        runs = [t for t in part if t.isdigit()]
        digits = "".join(runs)
        marks = "".join(sorted({t if not t.isalpha() else "d" for t in part if not t.isdigit()}))
        dotted = len(runs) == 4 and all(len(r) <= 3 and int(r) <= 255 for r in runs)
        between = {"".join(x for x in re.split(r"[0-9]+", "".join(part))[1:-1][k : k + 1]) for k in range(len(runs) - 1)}
        even = len(between) == 1
        out += [
            f"digits={len(digits)}", f"runs={'-'.join(str(len(r)) for r in runs) if len(runs) < 7 else 'many'}", f"marks={marks}",
            f"four={dotted}", f"four={dotted},even={even}", f"luhn={13 <= len(digits) <= 19 and luhn(digits)}", f"open={part[0] if not part[0].isdigit() else '0' if digits[:2] == '00' else 'd'}",
            f"paired={part.count('(') == part.count(')')}", f"dots={four_dots(part)}",
            f"luhn={13 <= len(digits) <= 19 and luhn(digits)},even={even or len(runs) == 1}",
        ]
    else:
        k = next(k for k in range(i, j) if _is_at(tokens, k))
        spelt = tokens[k] != "@"
        dots = [m for m in range(k + 1, j) if _is_dot(tokens, m)]
        out += [f"spelt={spelt}", f"dots={min(len(dots), 3)}", f"spelt={spelt},{sum(tokens[d] != '.' for d in dots) > 0}", f"last={len(part[-1])}", f"lastalpha={part[-1].isalpha()}", f"first={len(part[0]) > 1}", f"bracket={tokens[k] in '([{<'}"]
    side = "w" if before.isalnum() else "b" if before.isspace() else "^" if before == "^" else before
    out += [f"before={side}", f"after={'w' if after.isalnum() else 'b' if after.isspace() else after}"]
    out.append(f"goes_on={after in '._-@/+()' and (beyond.isalnum() or beyond in '[(')}")
    out.append(f"came_from={before in '._-@/=+#' }")
    return out


def four_dots(part: list[str]) -> bool:
    return sum(t == "." or t.lower() == "dot" for t in part) == 3


Lattice = list[tuple[int, int, int, np.ndarray]]


def lattice(tokens: list[str], known: dict[str, int], grow: bool = False) -> Lattice:
    """(start, end, kind, feature ids) of every candidate, ordered by end. Numeric segments may be any kind but email."""
    out = []
    for i, j, numeric in sorted(candidates(tokens), key=lambda c: (c[1], c[0])):
        names = features(tokens, i, j, numeric)
        for kind in (1, 2, 3) if numeric else (0,):
            ids = []
            for name in names:
                full = f"{KINDS[kind]}|{name}"
                if grow:
                    ids.append(known.setdefault(full, len(known)))
                elif full in known:
                    ids.append(known[full])
            out.append((i, j, kind, np.array(ids, dtype=np.int64)))
    return out


def best(n: int, segments: Lattice, scores: np.ndarray) -> list[tuple[int, int, int]]:
    """The segments of the best segmentation; a token outside any segment scores nothing."""
    top, back = np.zeros(n + 1), [None] * (n + 1)
    _advance(top, back, 0, n, [(i, j, kind) for i, j, kind, _ in segments], scores)
    return _trace(back)


def _advance(top: np.ndarray, back: list, first: int, last: int, segments: list[tuple[int, int, int]], scores: np.ndarray) -> None:
    """Carries the best scores from `first` to `last` by the segments that end in between, ordered by end."""
    at = 0
    for end in range(first + 1, last + 1):
        top[end] = top[end - 1]
        while at < len(segments) and segments[at][1] == end:
            i, _, kind = segments[at]
            if top[i] + scores[at] > top[end] + 1e-12:
                top[end], back[end] = top[i] + scores[at], (i, end, kind)
            at += 1


def _trace(back: list) -> list[tuple[int, int, int]]:
    out, end = [], len(back) - 1
    while end > 0:
        if back[end]:
            out.append(back[end])
            end = back[end][0]
        else:
            end -= 1
    return out[::-1]


def segmented(tokens: list[str], known: dict[str, int], w: np.ndarray, step: int = STEP) -> list[tuple[int, int, int]]:
    """The best segmentation of any number of tokens. Segments are built a step at a time, from the step's tokens and
    their neighbours, so only the best scores of all tokens are held."""
    n = len(tokens)
    top, back = np.zeros(n + 1), [None] * (n + 1)
    for first in range(0, n, step):
        last, low = min(first + step, n), max(first - BESIDE, 0)
        near = lattice(tokens[low : last + BESIDE], known)
        near = [(i + low, j + low, kind, ids) for i, j, kind, ids in near if first < j + low <= last]
        _advance(top, back, first, last, [s[:3] for s in near], np.array([w[ids].sum() for _, _, _, ids in near]))
    return _trace(back)


def marginals(n: int, segments: Lattice, scores: np.ndarray) -> tuple[float, np.ndarray]:
    """log Z, and the probability of every segment, by the forward-backward recursion over segment ends."""
    ahead = np.zeros(n + 1)
    at = 0
    for end in range(1, n + 1):
        total = ahead[end - 1]
        while at < len(segments) and segments[at][1] == end:
            total = np.logaddexp(total, ahead[segments[at][0]] + scores[at])
            at += 1
        ahead[end] = total
    behind = np.full(n + 1, -np.inf)
    behind[n] = 0.0
    at = len(segments) - 1
    for end in range(n, 0, -1):
        while at >= 0 and segments[at][1] == end:
            i = segments[at][0]
            behind[i] = np.logaddexp(behind[i], behind[end] + scores[at])
            at -= 1
        behind[end - 1] = np.logaddexp(behind[end - 1], behind[end])
    z = ahead[n]
    return z, np.exp(np.array([ahead[i] + scores[k] + behind[j] - z for k, (i, j, _, _) in enumerate(segments)]))


# ---------------------------------------------------------------- training


def _new_data(kind: str, rng: random.Random) -> str:
    """Made-up personal data in a usual form."""
    n = rng.randint
    if kind == "ip":
        return ".".join(str(n(1, 255)) for _ in range(4))
    if kind == "phone":
        return f"+{n(1, 99)} ({n(200, 999)}) {n(200, 999)}-{n(0, 9999):04d}"
    if kind == "card":
        digits = str(n(3, 6)) + "".join(str(n(0, 9)) for _ in range(rng.choice([12, 14, 14, 14, 14])))
        return next(digits + str(d) for d in range(10) if luhn(digits + str(d)))
    letters = "abcdefghijklmnoprstuvw"
    word = "".join(rng.choice(letters) for _ in range(n(2, 9)))
    host = "".join(rng.choice(letters) for _ in range(n(3, 8)))
    return f"{word}{rng.choice(['', '.', '_'])}{rng.choice(['', str(n(1, 99))])}x@{host}{rng.choice(['', str(n(0, 9))])}.{rng.choice(['example.com', 'org', 'net', 'de', 'co.uk', 'com'])}"


def _rewritten(kind: str, text: str, rng: random.Random) -> str:
    """The same data in a form that the patterns miss."""
    if kind == "email":
        local, _, host = text.partition("@")
        at, dot = rng.choice([(" (at) ", " (dot) "), (" [at] ", " [dot] "), (" at ", " dot "), (" AT ", " DOT "), ("(at)", "."), ("[at]", "[dot]"), (" @ ", "."), (" @ ", " . "), (" (at) ", "."), (" [at] ", "."), ("{at}", "{dot}")])
        return local + at + host.replace(".", dot)
    digits = re.sub(r"[^0-9]", "", text)
    if kind == "ip":
        return rng.choice(["[.]", " . ", "(.)", " dot ", "[dot]", "(dot)"]).join(text.split("."))
    if kind == "card":
        mark = rng.choice([".", "/", "_", " - ", "·"])
        return mark.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
    code = digits[:-10]
    forms = [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}) {b} {c}", f"00{code} {a} {b} {c}", f"00{code}-{a}-{b}-{c}", f"1-{a}-{b}-{c}", f"({a}){b}-{c}", f"+{code}/{a}/{b}{c}", f"{a}/{b}-{c}", f"{a} {b} {c}"]
    return rng.choice(forms)


def _decoy(rng: random.Random) -> str:
    """Numbers and signs that are nobody's data."""
    n = rng.randint
    return rng.choice([
        f"{n(1990, 2030)}-{n(1, 12):02d}-{n(1, 28):02d}", f"{n(0, 23)}:{n(0, 59):02d}", f"version {n(1, 20)}.{n(0, 9)}", f"{n(1, 9)}.{n(0, 20)}.{n(0, 99)}", f"{n(1, 999)},{n(0, 999):03d}.{n(0, 99):02d}",
        f"#{n(10**4, 10**7)}", f"{n(10**12, 10**16)}", f"{n(300, 999)}.{n(300, 999)}.{n(0, 999)}.{n(0, 999)}", f"ISBN 978-{n(0, 9)}-{n(10, 99)}-{n(100000, 999999)}-{n(0, 9)}", f"{n(10**5, 10**11)}", f"{n(1, 99)}%",
        f"pages {n(1, 400)}-{n(401, 900)}", f"{n(1990, 2030)} {n(1990, 2030)}", f"look at {n(1, 99)}", "meet at noon. dot", "@handle", f"id={n(10**8, 10**15)}", f"{n(1, 28)}.{n(1, 12)}.{n(1990, 2030)}", f"{n(10, 99)} {n(10, 99)} {n(10, 99)}", f"{n(1,12)}/{n(1,28)}/{n(1990,2030)}",
        f"x{n(100,999)}y{n(1000,9999)}", f"{n(1,9)}.{n(1,9)}.{n(1,9)}.{n(1,9)}.{n(1,9)}", f"{n(1990,2030)}.{n(1,12):02d}.{n(1,28):02d}.{n(10**3,10**4)}", f"{n(100,999)}-{n(10,99)}", f"{n(100,999)} {n(100,999)} {n(100,999)}", f"{n(10,99)}-{n(1000,9999)}",
    ])


def examples(sample: list[str], seed: int = 7, made: int = 900) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts with their true spans: the sampled regions as they are, and contexts with usual, rewritten and no data."""
    rng = random.Random(seed)
    out = [(t, base_spans(t)) for t in sample]
    contexts = [re.sub(r"[0-9@+]\S*", "", t) for t in sample] or [""]
    for i in range(made):
        around = rng.choice(contexts) if rng.random() < 0.7 else rng.choice(["call me on now", "write to us", "the and of", "card: ok", "from to", "tel. or"])
        words = around.replace("\n", " ").split(" ")
        at = rng.randint(0, len(words))
        left, right = " ".join(words[:at][-6:]), " ".join(words[at:][:6])
        left += " " if left else ""
        right = rng.choice([" ", ". ", ", ", " ", " "]) + right
        if i % 3 == 2:
            out.append((left + _decoy(rng) + right, []))
            continue
        kind = KINDS[i // 3 % 4]
        data = _new_data(kind, rng)
        data = _rewritten(kind, data, rng) if i % 3 else data
        text = left + data + right
        out.append((text, [(kind, len(left), len(left) + len(data))]))
    return out


def train(sample: list[str], rounds: int = 60, ridge: float = 0.02, rate: float = 0.5) -> dict[str, float]:
    """Weights that maximise the likelihood of the true segmentations, by adaptive gradient steps; deterministic."""
    known: dict[str, int] = {}
    cases = []
    for text, spans in examples(sample):
        tokens = TOKEN.findall(text)
        starts = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        segments = lattice(tokens, known, grow=True)
        if not segments:
            continue
        true = {(KINDS.index(k), a, b) for k, a, b in spans}
        gold = np.array([(k, starts[i], starts[j]) in true for i, j, k, _ in segments], dtype=float)
        flat = np.concatenate([ids for _, _, _, ids in segments])
        owner = np.repeat(np.arange(len(segments)), [len(ids) for _, _, _, ids in segments])
        cases.append((len(tokens), segments, gold, flat, owner))
    w, seen = np.zeros(len(known)), np.full(len(known), 1e-8)
    for _ in range(rounds):
        grad = -ridge * w
        for n, segments, gold, flat, owner in cases:
            scores = np.bincount(owner, w[flat], minlength=len(segments))
            _, p = marginals(n, segments, scores)
            grad += np.bincount(flat, (gold - p)[owner], minlength=len(w))
        seen += grad * grad
        w += rate * grad / np.sqrt(seen)
    return {name: float(w[i]) for name, i in known.items() if abs(w[i]) > 1e-6}


def sample_regions(docs: DataFrame, key: str, text: str, most_documents: int, most_regions: int) -> list[str]:
    """At most `most_regions` regions of the documents with marks whose keys have the smallest hashes."""
    marked = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).filter(F.col("text").rlike("[0-9@]"))
    chosen = marked.select("k").dropna().orderBy(F.xxhash64("k")).limit(most_documents).distinct()
    # at most `most_documents` keys, so small at any size of the corpus
    some = marked.join(F.broadcast(chosen), "k", "left_semi")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [t[a:b] for t in texts(batch) for a, b in regions(t)[:20] if b - a <= 400]
            yield pa.RecordBatch.from_pydict({"region": pa.array(found, pa.string())})

    rows = some.select("text").mapInArrow(cut, "region string").orderBy(F.xxhash64("region"), "region").limit(most_regions)
    return [r.region for r in rows.collect()]


# ---------------------------------------------------------------- finding


def added_spans(text: str, base: list[tuple[str, int, int]], weights: dict[str, float], known: dict[str, int], w: np.ndarray) -> list:
    """Spans the random field finds that touch no base span."""
    taken = sorted((a, b) for _, a, b in base)
    out = []
    for low, high in regions(text):
        part = text[low:high]
        tokens = TOKEN.findall(part)
        starts = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        for i, j, kind in segmented(tokens, known, w):
            a, b = low + int(starts[i]), low + int(starts[j])
            if not any(x < b and a < y for x, y in taken):
                out.append((KINDS[kind], a, b))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1], s[2])))


def find(
    docs: DataFrame, key: str = "doc_id", text: str = "text", sample_documents: int = 2_000, sample_size: int = 600
) -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added), one row per input row.

    The counts and the digest are of the base spans, `spans` has base and added ones as kind:start:end in code
    points. NULL and empty texts have none. The random field is trained on at most `sample_size` regions of at most
    `sample_documents` documents; every text is searched whole.
    """
    weights = train(sample_regions(docs, key, text, sample_documents, sample_size))
    known = {name: i for i, name in enumerate(weights)}
    w = np.array([*weights.values()])
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("text"))
    names = [f"n_{k}" for k in KINDS]
    fields = StructType.fromDDL(", ".join(f"{n} long" for n in names) + ", base_sha256 string, spans string, n_added long").fields
    schema = StructType([StructField("_key", rows.schema["_key"].dataType), *fields])
    nothing = sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 8_000_000):
            out = []
            for t in texts(batch):
                if not MARK.search(t) and " dot " not in t.lower():
                    out.append((0, 0, 0, 0, nothing, "", 0))
                    continue
                base = base_spans(t)
                more = added_spans(t, base, weights, known, w)
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                out.append((*counts, sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)))
            columns = [pa.array(c, pa.string() if f.dataType.typeName() == "string" else pa.int64()) for c, f in zip(zip(*out, strict=True), fields, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), *columns], schema.names)

    return rows.mapInArrow(run, schema).withColumnRenamed("_key", key)
