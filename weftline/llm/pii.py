"""Personal data by candidate generation and boosted trees.

Strict patterns give the base spans, which always stay. Around them, loose generators propose many overlapping spans
(each run of neighbouring groups of digits, spelled-out mail addresses, IPv6-like runs); boosted trees score each from its
format and its context, and of those whose calibrated probability passes their kind's threshold the likeliest that do not
overlap are redacted too. The trees are trained here, on the candidates of texts with marked spans that a seeded generator
writes; nothing is learnt from the documents. All steps take time in proportion to a text's length.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.boosting import BoostedTrees
from weftline.llm.common import arrow_map, read_table

KINDS = ("email", "ip", "card", "phone")
#: Texts that the classifier is trained on; a quarter of as many more are held out for calibration and thresholds.
TRAIN_ROWS = 6000
#: The least precision on held-out rows that a kind's threshold must reach, and the lowest threshold there is.
PRECISION, LEAST = 0.98, 0.6

_DIGIT = re.compile(r"[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){2}\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        n = n * 2 if k % 2 else n
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Each ``@`` can end one local part only: the run before it, from the last match on. So long runs cost their length once."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        begin = at - len(_LOCAL_END.match(text[at - 1 : end - 1 if end else None : -1] if at > end else "").group())
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((0, begin, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) by the four strict patterns, leftmost and non-overlapping within a kind, by kind and start."""
    out = _emails(text) if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(x) <= 3 and int(x or 0) <= 255 for x in (part.lstrip("0") for part in m.group().split(".")))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]
    return out


#: Groups of digits that stand close together; each run of neighbouring groups may be a number of its own.
_CHAIN = re.compile(r"[0-9]++(?:[ ().\-/]{1,3}+[0-9]++)*")
_GROUP, _OTHER = re.compile(r"[0-9]+"), re.compile(r"[^0-9A-Za-z]+")
#: Most digits of a number, and most groups that it is written in.
_MOST_DIGITS, _MOST_GROUPS = 19, 8
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{2,64} ?(?:\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[A-Za-z0-9-]{2,63}){1,4}", re.I)
_SIX = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
#: IPv6 with one run of zeros left out.
_SHORT_SIX = re.compile(r"(?<![0-9A-Za-z:])(?=[0-9A-Fa-f:]*::)(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?(?![0-9A-Za-z:])")
_AT, _DOT = re.compile(r"[(\[{]at[)\]}]| at ", re.I), re.compile(r"[(\[{]dot[)\]}]| dot |\.", re.I)
_HINTS = (re.compile(r"mail|contact|write", re.I), re.compile(r"\bip\b|host|server|addr", re.I), re.compile(r"card|visa|master|credit|pay", re.I), re.compile(r"tel|phone|call|fax|mobile|dial", re.I))
_NEAR_HINTS = (re.compile(r"(?:mail|contact|write)\W{0,3}\w{0,3}\W{0,2}$", re.I), re.compile(r"(?:\bip|host|server|addr\w*)\W{0,3}$", re.I), re.compile(r"(?:card|visa|master|credit|pay\w*)\W{0,3}\w{0,4}\W{0,2}$", re.I), re.compile(r"(?:tel|phone|call|fax|mobile|dial)\W{0,3}$", re.I))
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-./][01]?[0-9][-./][0-3]?[0-9]|[0-3]?[0-9][-./][01]?[0-9][-./](?:19|20)[0-9]{2}")


def _numbers(text: str) -> list[Span]:
    """Every run of neighbouring groups of digits as phone (7 to 15 digits) and as card (13 to 19 that pass Luhn).

    A text of n digits has at most ``_MOST_GROUPS`` times n of them, as runs are bounded.
    """
    out: list[Span] = []
    for m in _CHAIN.finditer(text):
        if m.end() - m.start() < 7:
            continue
        groups = [g.span() for g in _GROUP.finditer(text, *m.span())]
        if m.start() and text[m.start() - 1].isascii() and text[m.start() - 1].isalpha():
            groups = groups[1:]
        if m.end() < len(text) and text[m.end()].isascii() and text[m.end()].isalpha():
            groups = groups[:-1]
        for i, (begin, _) in enumerate(groups):
            n, digits, last = 0, "", begin
            if begin and text[begin - 1] in "+(":
                begin -= 1
            for k, (a, e) in enumerate(groups[i : i + _MOST_GROUPS]):
                n += e - a
                # brackets hold an area code, which nothing but a short code of a country stands before
                if n > _MOST_DIGITS or (k and "(" in text[last:a] and (k > 1 or last - begin > 3)):
                    break
                last = e
                digits += text[a:e]
                if n < 7 or (run := text[begin:e]).count("(") != run.count(")") or _DATE.match(run):
                    continue
                if n <= 15:
                    out.append((3, begin, e))
                if n >= 13 and luhn(digits):
                    out.append((2, begin, e))
    return out


def candidates(text: str) -> list[Span]:
    """Overlapping proposals: every run of groups of digits as card and as phone, spelled-out addresses, colon-separated runs."""
    out: list[Span] = []
    if _AT.search(text) and _DOT.search(text):
        for m in _SPELLED.finditer(text):
            ends = [d.start() for d in _DOT.finditer(text, m.start() + _AT.search(m.group()).end(), m.end())]
            out += [(0, m.start(), e) for e in [*ends[1:], m.end()]]
    if "::" in text:
        out += [(1, *m.span()) for m in _SHORT_SIX.finditer(text) if len(m.group()) > 2 and len(re.findall(r"[0-9A-Fa-f]+", m.group())) <= 7]
    if _DIGIT.search(text):
        out += _numbers(text)
        if ":" in text:
            out += [(1, *m.span()) for m in _SIX.finditer(text)]
    return out


def _open(text: str, base: list[Span]) -> list[Span]:
    """The candidates that overlap no base span."""
    taken: list[list[int]] = []
    for _, b, e in sorted(base, key=lambda x: x[1]):
        if taken and b < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([b, e])
    begins, ends = [x[0] for x in taken], [x[1] for x in taken]
    # of the parts that begin before a candidate's end the last one ends last
    return [c for c in candidates(text) if not ((k := bisect_left(begins, c[2])) and ends[k - 1] > c[1])]


def _gap(text: str) -> int:
    """How far the first digit is from the start of a text, at most 5."""
    m = _DIGIT.search(text, 0, 5)
    return m.start() if m else 5


def features(text: str, span: Span) -> list[float]:
    """Numbers that describe a candidate's format and the text around it."""
    kind, begin, end = span
    s, before, after = text[begin:end], text[max(0, begin - 24) : begin], text[end : end + 12]
    groups, seps = _GROUP.findall(s), _OTHER.findall(s)
    digits = "".join(groups)
    sizes = [*map(len, groups)] or [0]
    first, last, lower = before[-1:], after[:1], s.lower()
    near = before[-6:] + after[:6]
    return [
        kind == 0, kind == 1, kind == 2, kind == 3, len(s), len(digits), len(groups), len(seps), len(set(seps)),
        sizes[0], sizes[-1], max(sizes), min(sizes), sizes[1] if len(sizes) > 1 else 0,
        s[0] == "+", s[0] == "(" and ")" in s, luhn(digits) if 13 <= len(digits) <= 19 else -1, "/" in s, s.count("."), s.count("-"), s.count(" "), s.count(":"),
        bool(_DATE.search(s)), len(set(digits)), digits[:1] == "0", bool(_HINTS[kind].search(before)), len(_DIGIT.findall(near)),
        first != "" and first in ".,=#$€£%/-_:", last != "" and last in "%€$£/-_:", "(at" in lower or "[at" in lower or "{at" in lower, "dot" in lower, "::" in s, s.count("(") == s.count(")"),
        _gap(before[::-1]), _gap(after), s.count("("), first.isalnum(), last.isalnum(), bool(_NEAR_HINTS[kind].search(before)), digits[:1] == "1", ". " in s, s.rfind(".") / len(s),
    ]


def _luhn_number(r: random.Random, n: int) -> str:
    head = "".join(r.choice("0123456789") for _ in range(n - 1))
    return next(head + d for d in "0123456789" if luhn(head + d))


def labelled(rows: int, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """Texts with marked spans, in every other one personal data in formats of many countries, in the others things that
    look like it. Some phone numbers and cards stand side by side."""
    r, out = random.Random(seed), []
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghilmnoprstuvz") for _ in range(r.randint(2, 9)))
    f = lambda n: r.choice("23456789") + d(n - 1)
    part = lambda n: ":".join(r.choice([d(4), "%x" % r.randrange(1 << 16), "fe80"]) for _ in range(n))
    for k in range(rows):
        kind, good = r.choice((0, 1, 2, 2, 3, 3, 3, 3)), k % 2 == 0
        hint = {0: ["mail ", "contact: ", "write to "], 1: ["host ", "server ", "ip "], 2: ["card ", "visa ", "pay with "], 3: ["tel ", "phone: ", "call ", "fax ", "dial "]}[kind]
        hinted = r.random() < (0.5 if good else 0.1)
        many = 1
        if kind == 0:
            at, dot = r.choice([("(at)", "(dot)"), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" at ", " dot ")])
            items = [f"{word()}{r.choice(['', '.', '_'])}{word()}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'de', 'fr', 'io'])}" if good else f"{word()} at {word()}{r.choice(['. ', '.'])}{word()}"]
            items = [items[0].upper() if good and r.random() < 0.2 else items[0]]
        elif kind == 1:
            items = [r.choice([part(8), f"{r.choice(['2001', 'fe80'])}:{part(r.randint(1, 2))}::{part(r.randint(1, 4))}", f"{r.choice(['2001:db8', 'fe80'])}::{part(r.randint(1, 4))}"]) if good else r.choice([f"{d(2)}:{d(2)}:{d(2)}:{d(2)}", f"{d(1)}:{d(2)}:{d(2)}:{d(3)}:{d(2)}", f"{d(1)}::{d(1)}", f"a::{d(1)}"])]
        elif kind == 2:
            many = 2 if good and r.random() < 0.2 else 1
            cards = [_luhn_number(r, 16) for _ in range(many)]
            cut = r.choice([".", "/", " - "])
            items = [cut.join(n[a : a + 4] for a in range(0, 16, 4)) for n in cards] if good else [r.choice([d(r.randint(13, 19)), ".".join(d(4) for _ in range(4)), f"{d(8)}-{d(8)}", f"{d(5)}.{d(4)}.{d(4)}", f"{(n := _luhn_number(r, 14))[:5]}.{n[5:9]}.{n[9:]}", f"{(n := _luhn_number(r, 16))[:8]}/{n[8:]}", f"{(n := _luhn_number(r, 15))[:3]}.{n[3:9]} {n[9:]}"])]
        else:
            many = 2 if r.random() < 0.3 else 1
            forms = [
                lambda: f"({f(3)}) {f(3)}-{d(4)}", lambda: f"{f(3)}-{f(3)}-{d(4)}", lambda: f"{f(3)}.{f(3)}.{d(4)}", lambda: f"({f(3)}){f(3)}-{d(4)}", lambda: f"{f(3)} {f(3)} {d(4)}",
                lambda: f"0{d(2)} {d(4)} {d(4)}", lambda: f"0{d(3)} {d(4)} {d(4)}", lambda: f"0{d(3)} {d(3)} {d(3)}", lambda: f"0{f(1)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"0{d(3)}/{d(7)}", lambda: f"0{d(3)} {d(6)}",
            ]
            others = [
                lambda: f"20{d(2)}-0{f(1)}-1{d(1)}", lambda: f"1{d(1)}.0{f(1)}.19{d(2)}", lambda: f"19{d(2)}-20{d(2)}", lambda: d(r.randint(7, 15)), lambda: f"{d(1)}.{d(2)}.{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(3)}", lambda: f"{d(4)} {d(4)}",
                lambda: f"{d(2)}-{d(5)}-{d(2)}-{d(1)}", lambda: f"{d(2)}/{d(2)}/20{d(2)}", lambda: f"{d(3)} {d(3)} {d(3)}", lambda: f"{d(5)}.{d(4)}", lambda: f"{d(1)}-{d(6)}-{d(1)}", lambda: f"20{d(2)}-0{f(1)}-1{d(1)} {d(2)}", lambda: " ".join(d(r.randint(1, 3)) for _ in range(r.randint(4, 9))),
            ]
            form = r.choice(forms if good else others)
            items = [form() for _ in range(many)]
            if good and many == 1 and r.random() < 0.08:
                items, hinted = [f(10)], True  # without groups only what stands before it tells a phone number
        lead = r.choice(hint) if hinted else f"{word()} " + ("no. " if r.random() < 0.2 and not good else "")
        near = good and kind == 3 and any(c in items[0] for c in "(-.")  # other numbers may stand beside one with marks of its own
        text, spans = f"{word()} {word()} {lead}" + (f"{d(r.randint(1, 5))} " if near and r.random() < 0.25 else ""), []
        gap = r.choice([" ", ", ", " / ", " or "])
        for j, item in enumerate(items):
            text += gap if j else ""
            spans.append((kind, len(text), len(text) + len(item)))
            text += item
        text += f" {d(r.randint(1, 5))}" if near and r.random() < 0.15 else ""
        out.append((f"{text}{r.choice(['', '', '.', ','])} {word()} {word()}", spans if good else []))
    return out


def examples(texts: list[tuple[str, list[Span]]]) -> tuple[list[tuple[str, Span]], np.ndarray]:
    """All open candidates of the texts, and whether each is a marked span."""
    rows, labels = [], []
    for t, spans in texts:
        for c in _open(t, base_spans(t)):
            rows.append((t, c))
            labels.append(float(c in spans))
    return rows, np.array(labels)


@lru_cache(maxsize=2)
def model(rows: int = TRAIN_ROWS, seed: int = 7) -> tuple[BoostedTrees, tuple[float, ...]]:
    """The trees, and for each kind the lowest threshold that is as precise on held-out candidates as PRECISION asks."""
    train, y = examples(labelled(rows, seed))
    held, z = examples(labelled(rows // 4, seed + 1))
    x, w = (np.array([features(t, s) for t, s in part], float) for part in (train, held))
    trees = BoostedTrees(rounds=80, depth=4).fit(x, y).calibrate(w, z)
    p, kind, limits = trees.probability(w), np.array([s[0] for _, s in held]), []
    for k in range(len(KINDS)):
        ps, zs = p[kind == k], z[kind == k]
        fits = [c for c in np.unique(np.append(ps, (LEAST, 1.0))) if c >= LEAST and (zs[ps >= c].mean() if (ps >= c).any() else 1.0) >= PRECISION]
        limits.append(float(fits[0]))
    return trees, tuple(limits)


def _likeliest(found: list[tuple[float, Span]]) -> list[Span]:
    """The likeliest candidates that do not overlap; of equally likely ones the longest."""
    out: list[Span] = []
    found.sort(key=lambda x: (x[1][1], x[1][2]))
    at = 0
    while at < len(found):  # candidates that hang together by overlaps are settled apart from all others
        end, to = found[at][1][2], at + 1
        while to < len(found) and found[to][1][1] < end:
            end = max(end, found[to][1][2])
            to += 1
        chosen: list[tuple[int, int, int]] = []  # (start, end, kind), disjoint
        for _, (k, b, e) in sorted(found[at:to], key=lambda x: (-round(x[0], 3), x[1][1] - x[1][2], x[1])):
            j = bisect_left(chosen, (e, 0, 0))
            if not (j and chosen[j - 1][1] > b):
                insort(chosen, (b, e, k))
        out += [(k, b, e) for b, e, k in chosen]
        at = to
    return out


def all_spans(texts: list[str], trained: tuple[BoostedTrees, tuple[float, ...]], most: int = 100_000) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text. An added span overlaps neither a base span nor a likelier added one.

    Candidates are scored ``most`` at a time, so memory is bounded by the longest text, not by what it proposes.
    """
    trees, limits = trained
    base = [base_spans(t) for t in texts]
    extra: dict[int, list[tuple[float, Span]]] = {}
    waiting: list[tuple[int, Span]] = []

    def score() -> None:
        if waiting:
            p = trees.probability(np.array([features(texts[i], c) for i, c in waiting], float))
            for (i, c), q in zip(waiting, p.tolist(), strict=True):
                if q >= limits[c[0]]:
                    extra.setdefault(i, []).append((q, c))
            waiting.clear()

    for i, t in enumerate(texts):
        if base[i] or _DIGIT.search(t) or _AT.search(t) or "::" in t:
            for c in _open(t, base[i]):
                waiting.append((i, c))
                if len(waiting) >= most:
                    score()
    score()
    return [(b, sorted(b + _likeliest(extra.get(i, [])))) for i, b in enumerate(base)]


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{b}:{e}" for k, b, e in spans)


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with each run of overlapping spans replaced by the name of the kind that begins it."""
    out, at = [], 0
    for k, b, e in sorted(spans, key=lambda s: (s[1], s[0])):
        if b >= at:
            out += [text[at:b], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of FOUND for each row: counts and digest of the base spans, and all spans.

    A null text is empty, so it has no spans; a null doc_id stays null; repeated rows each get a row. Places are code
    points, ends exclusive. Texts are read whole, whatever their length.
    """
    trained = model()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        found = all_spans(texts, trained)
        counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
        sha = pa.array([hashlib.sha256(spelled(base).encode()).hexdigest() for base, _ in found], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), *counts, sha, pa.array([spelled(s) for _, s in found], pa.string())], [c.split()[0] for c in FOUND.split(", ")])

    return arrow_map(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, FOUND)


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind and ``n_chars``, where there is one, counted anew. All columns stay."""
    trained, names = model(), docs.columns
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = batch.column(at).to_pylist()
        done = [t and redact(t, s) for t, (_, s) in zip(raw, all_spans([t or "" for t in raw], trained), strict=True)]
        cols = list(batch.columns)
        cols[at] = pa.array(done, batch.schema.field(at).type)
        if chars is not None:
            old = batch.column(chars).to_pylist()
            cols[chars] = pa.array([o if a == b else len(b) for a, b, o in zip(raw, done, old, strict=True)], batch.schema.field(chars).type)
        return pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return arrow_map(docs, run, docs.schema)


def op7_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(read_table(spark, sf_dir, "documents"))
