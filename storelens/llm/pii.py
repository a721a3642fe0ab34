"""Personal data in text: base patterns, and a character BiLSTM-CRF that adds what they miss (operator 11).

Four kinds: email, ip, card, phone. The base spans are exact patterns with checks.
The model (:mod:`storelens.llm.crf_lstm`) is trained from labelled spans: windows
of the documents with their base spans, and the same prose with written-in
variants (numbers without a plus, spelled-out at signs, defanged addresses, dotted
cards) and look-alikes (dates, versions, amounts, hashes) labelled as outside.

Every text is cut into windows of ``WINDOW`` code points, one each ``STRIDE``. A
span has to hold a digit, an at sign or a bracketed ``at``; windows without any of
these are outside by that rule, so they are not run (the result is the same).
Spans that reach a window's edge are joined with what the next window saw of
them; of all spans of a document, those that the windows disagree on included, the
set without overlaps and with the largest total lead is kept (weighted interval
scheduling), beside the base spans, which always stay. A model span must also pass
its kind's check (Luhn, parts at most 255, number of digits, a host with a dot).

Fitting: at most ``SAMPLE`` windows of each sort, taken by the hash of id and text
from a hashed share of the documents that is bounded likewise. Everything else
covers all rows and whole texts.

Defined results: a null text counts as empty; without spans the counts are 0 and
the lists empty; repeated rows get the same spans each; without any document the
model learns from the written variants alone; extra columns are not carried over.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.llm.common import map_text, table
from storelens.llm.crf_lstm import Tagger, classes

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 96, 48     #: code points of a window, and from one window to the next
SAMPLE = 1500               #: windows of each sort (with spans, with digits, prose) to learn from at most
WRITTEN = 5000              #: windows with a written-in item
STEPS = 300                 #: training steps of 64 windows
LEAD = 1.0                  #: least mean lead of a model span over "outside"
ROWS = 512                  #: windows decoded together

TRIGGER = re.compile(r"[0-9@]|[\[({<]\x20?[aA][tT]\x20?[\])}>]")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
# a match can only start where a run of digits starts, so both runs are taken whole
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AT = re.compile(r"\x20?[\[({<]\x20?at\x20?[\])}>]\x20?", re.I)
_DOT = re.compile(r"\x20?[\[({<]\x20?(?:dot|\.)\x20?[\])}>]\x20?", re.I)
_DATE = re.compile(r"(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})(?!\d)")
#: what a model's phone number may look like beyond the base pattern
_LOOSE = re.compile(r"(?:\+|00)?\(?[0-9][0-9\x20().-]*[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _ip_ok(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, sorted; linear in the text's length."""
    found = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL_CHARS[min(ord(text[start - 1]), 128)]:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            found.append((start, 0, host.end()))
            done = host.end()
        # an at sign cannot lie inside a host, and what precedes it is free again unless matched
        done = max(done, at + 1)
        at = text.find("@", at + 1)
    if _ANY_DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _ip_ok(m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                d = _digits(m.group())
                if 12 <= len(d) <= 19 and _luhn(d):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(found)


_LOCAL_CHARS = [bool(re.match(r"[A-Za-z0-9._%+-]", chr(c))) for c in range(128)] + [False]
_ANY_DIGIT = re.compile("[0-9]")


def _checked(text: str, start: int, end: int, kind: int) -> tuple[int, int] | None:
    """A model span, widened to whole runs of letters and digits and stripped of loose ends, if it passes its check."""
    for _ in range(WINDOW):
        if start and text[start - 1].isalnum() and text[start].isalnum():
            start -= 1
        elif end < len(text) and text[end].isalnum() and text[end - 1].isalnum():
            end += 1
        else:
            break
    while start < end and not (text[start].isalnum() or text[start] in "(+"):
        start += 1
    while start < end and not text[end - 1].isalnum():
        end -= 1
    s = text[start:end]
    if kind == 0:
        plain = _DOT.sub(".", _AT.sub("@", s))
        name, _, host = plain.partition("@")
        ok = bool(_LOCAL.match(name) and _HOST.fullmatch(host) and any(c.isalpha() for c in host))
    elif kind == 1:
        parts = _DOT.sub(".", s).split(".")
        ok = len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts) and _ip_ok(parts)
    elif kind == 2:
        d = _digits(s)
        ok = (13 <= len(d) <= 19 and d[0] in "3456" and _luhn(d) and all(c.isdigit() or c in " .-" for c in s))
    else:
        d = _digits(s)
        ok = bool(9 <= len(d) <= 15 and _LOOSE.fullmatch(s) and not _DATE.match(s) and len(s) > len(d))
        ok = ok and not (s.count(".") == 3 and len(s) == len(d) + 3)
    return (start, end) if ok else None


def windows_of(text: str) -> list[int]:
    """Starts of the grid's windows that hold a digit, an at sign or a bracketed at."""
    last = max(0, -(-(len(text) - WINDOW) // STRIDE)) * STRIDE
    starts: set[int] = set()
    seen = -1
    for m in TRIGGER.finditer(text):
        a, b = m.span()
        high = min(a // STRIDE * STRIDE, last)
        if b - a == 1 and high == seen:  # same windows as the trigger before
            continue
        seen = high if b - a == 1 else -1
        low = max(0, -(-(b - WINDOW) // STRIDE) * STRIDE)
        starts.update(range(low, high + 1, STRIDE))
    return sorted(starts)


def _runs(labels: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(from, to, kind) of the spans of one window's labels."""
    t, n = 0, len(labels)
    while t < n:
        if labels[t]:
            kind, end = (labels[t] - 1) // 2, t + 1
            while end < n and labels[end] == 2 * kind + 2:
                end += 1
            yield t, end, int(kind)
            t = end
        else:
            t += 1


def reconcile(text: str, pieces: list[tuple[int, int, int, float, bool, bool]],
              base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The model spans to add, from all windows' pieces of a text: (start, end, kind, lead, cut left, cut right).

    Cut pieces of one kind that overlap are one span; then checked spans free of
    the base ones compete by their total lead, and the best set without overlaps stays.
    """
    joined: list[list] = []
    open_at: dict[int, list] = {}
    for start, end, kind, lead, cut_left, cut_right in sorted(pieces):
        last = open_at.get(kind)
        if last and start <= last[1] and (cut_left or last[4]):
            last[4] = last[4] if end < last[1] else cut_right if end > last[1] else last[4] and cut_right
            last[1], last[3] = max(last[1], end), max(last[3], lead)
            continue
        open_at[kind] = item = [start, end, kind, lead, cut_right]
        joined.append(item)
    reach = list(itertools.accumulate((b[2] for b in base), max))
    best: dict[tuple[int, int, int], float] = {}
    for start, end, kind, lead, _ in joined:
        span = _checked(text, start, end, kind) if lead >= LEAD else None
        if span and TRIGGER.search(text, *span):
            i = bisect.bisect_left(base, (span[1],))
            if not i or reach[i - 1] <= span[0]:
                key = (span[0], kind, span[1])
                best[key] = max(best.get(key, 0), lead * (span[1] - span[0]))
    if not best:
        return []
    spans = sorted(best, key=lambda s: (s[2], s))
    ends = [s[2] for s in spans]
    value, take = [0.0], []
    for k, s in enumerate(spans):
        before = bisect.bisect_right(ends, s[0], 0, k)
        with_it = value[before] + best[s]
        take.append((with_it > value[k], before))
        value.append(max(value[k], with_it))
    out, k = [], len(spans)
    while k:
        chosen, before = take[k - 1]
        if chosen:
            out.append(spans[k - 1])
            k = before
        else:
            k -= 1
    return sorted(out)


def added_spans(texts: list[str], bases: list[list], model: Tagger) -> list[list[tuple[int, int, int]]]:
    """The model's spans of each text."""
    out: list[list] = [[] for _ in texts]
    pieces: list[list] = [[] for _ in texts]
    pending: list[tuple[int, int, np.ndarray]] = []

    def decode():
        if not pending:
            return
        codes = np.zeros((len(pending), WINDOW), np.uint8)
        for r, (_, _, c) in enumerate(pending):
            codes[r, :len(c)] = c
        labels, lead = model.decode(codes)
        for r, (d, at, c) in enumerate(pending):
            if not labels[r].any():
                continue
            whole = len(texts[d])
            for a, b, kind in _runs(labels[r, :len(c)]):
                pieces[d].append((at + a, at + b, kind, float(lead[r, a:b].mean()),
                                  a == 0 and at > 0, b == WINDOW and at + b < whole))
        pending.clear()

    for d, text in enumerate(texts):
        starts = windows_of(text) if text else []
        if starts:
            for at in starts:
                pending.append((d, at, classes(text[at:at + WINDOW])))
                if len(pending) == ROWS:
                    decode()
    decode()
    for d, found in enumerate(pieces):
        if found:
            out[d] = reconcile(texts[d], found, bases[d])
    return out


# ---------------------------------------------------------------- training

def _written(rng: np.random.Generator, words: list[str]) -> tuple[int, str]:
    """A made-up item: (kind, or -1 for a look-alike; text)."""
    def n(k):
        return "".join(str(d) for d in rng.integers(0, 10, k))

    def pick(*xs):
        return xs[rng.integers(len(xs))]
    word = "".join(c for c in words[rng.integers(len(words))] if c.isascii() and c.isalnum()).lower() or "mail"
    other = "".join(c for c in words[rng.integers(len(words))] if c.isascii() and c.isalnum()).lower() or "host"
    octets = [str(x) for x in rng.integers(0, 256, 4)]
    sort = rng.integers(0, 9)
    if sort == 0:
        at, dot = pick(("@", "."), ("(at)", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), (" [at] ", "."), ("@", "[.]"))
        return 0, word[:14] + pick("", ".", "_") + pick("", n(2), other[:6]) + at + other[:12] + pick("", n(1)) + dot + pick("com", "org", "net", "de", "fr", "es", "io")
    if sort == 1:
        return 1, pick(".", "[.]", "(.)").join(octets)
    if sort == 2:
        body = pick("4", "51", "37", "6011") + n(20)
        size = pick(16, 16, 16, 15)
        d = next(body[:size - 1] + str(c) for c in range(10) if _luhn(body[:size - 1] + str(c)))
        sep = pick("", " ", "-", ".")
        return 2, sep.join([d[:4], d[4:8], d[8:12], d[12:]])
    if sort in (3, 4):
        a, b, c = n(3), n(3), n(4)
        joint = pick("-", ".", " ")
        return 3, pick(f"+1 ({a}) {b}-{c}", f"+{pick(33, 34, 49, 44)} {n(2)} {n(7)}", f"({a}) {b}{joint}{c}",
                       f"{a}{joint}{b}{joint}{c}", f"{a}{joint}{b}{joint}{c}", f"00{pick(33, 34, 49)} {n(2)} {n(7)}")
    y, m, d = str(rng.integers(1900, 2040)), f"{rng.integers(1, 13):02d}", f"{rng.integers(1, 29):02d}"
    hexes = "".join("0123456789abcdef"[x] for x in rng.integers(0, 16, 24))
    return -1, pick(f"{y}-{m}-{d}", f"{d}.{m}.{y}", f"{m}/{d}/{y}", y, f"{m}:{d}", f"${n(1)},{n(3)}.{n(2)}", f"{n(2)}.{n(1)}.{n(1)}",
                    f"{n(1)}.{n(5)}", hexes, f'token = "{hexes}"', f"password={hexes[:18]}", n(pick(2, 4, 7, 9, 22, 30)),
                    f"978-3-{n(2)}-{n(6)}-{n(1)}", f"@{word}", f"{n(2)}-{n(2)}", f"AKIA{hexes[:16].upper()}", f"{n(3)}%",
                    f"sk-{word}{n(6)}", f"#{n(5)}", f"({y})", f"{word}{n(3)}", f"v{n(1)}.{n(2)}.{n(1)}.{n(4)}")


def training_rows(examples: list[tuple[str, list[tuple[int, int, int]]]], prose: list[str],
                  seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Codes and labels: the labelled examples, and prose with written-in items."""
    rng = np.random.default_rng(seed)
    made = [(t, s) for t, s in examples if t]
    prose = [p for p in prose if p.strip()] or ["a line of plain words to write into", "une ligne de mots simples"]
    for text in prose * max(1, -(-WRITTEN // len(prose))):
        words = text.split()
        at = int(rng.integers(0, max(1, len(text) - 40)))
        at = max(text.rfind(" ", 0, at + 1), 0)
        kind, item = _written(rng, words)
        left = text[:at] + (" " if at and rng.random() < 0.95 else "")
        spans = [(len(left), kind, len(left) + len(item))] if kind >= 0 else []
        made.append((left + item + (" " if rng.random() < 0.7 else "." if rng.random() < 0.5 else ", ") + text[at:].lstrip(), spans))
        if len(made) >= len(examples) + WRITTEN:
            break
    codes = np.zeros((len(made), WINDOW), np.uint8)
    gold = np.zeros((len(made), WINDOW), np.int64)
    for r, (text, spans) in enumerate(made):
        c = classes(text[:WINDOW])
        codes[r, :len(c)] = c
        for start, kind, end in spans:
            start, end = max(start, 0), min(end, WINDOW)
            if start < end:
                gold[r, start:end] = 2 * kind + 2
                gold[r, start] = 2 * kind + 1
    return codes, gold


def train(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", steps: int = STEPS,
          seed: int = 7) -> Tagger:
    """The tagger, learnt from a bounded sample of the documents' windows."""
    total = docs.count()  # from the file footers
    share = min(1.0, 20 * SAMPLE / max(total, 1))
    h = F.xxhash64(F.col(id_col).cast("string"), text_col)
    part = (docs.select(h.alias("h"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
            .where((F.col("h") / F.lit(2.0 ** 64) + 0.5) < share))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                base = base_spans(text)
                at = 0 if len(text) <= WINDOW else h % (len(text) - WINDOW)
                if base:
                    start = base[h % len(base)][0]
                    at = max(0, start - h // 7 % 60)
                    rows.append((h, 0, text[at:at + WINDOW], [x for s in base for x in (s[0] - at, s[1], s[2] - at)
                                                              if s[2] > at and s[0] < at + WINDOW]))
                    continue
                m = TRIGGER.search(text)
                if m:
                    at = max(0, m.start() - h // 7 % 60)
                rows.append((h, 1 if m else 2, text[at:at + WINDOW], []))
            yield pa.RecordBatch.from_pydict(
                {k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(
                    [("h", pa.int64()), ("sort", pa.int32()), ("text", pa.string()), ("spans", pa.list_(pa.int32()))])})

    from pyspark.sql import Window
    found = part.mapInArrow(pick, "h bigint, sort int, text string, spans array<int>").dropDuplicates(["h"])
    w = Window.partitionBy("sort").orderBy("h", "text")
    rows = (found.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= SAMPLE)
            .orderBy("sort", "h").collect())
    examples = [(r.text, [tuple(r.spans[i:i + 3]) for i in range(0, len(r.spans), 3)]) for r in rows if r.sort < 2]
    prose = [r.text for r in rows if r.sort == 2]
    codes, gold = training_rows(examples, prose)
    model = Tagger(len(KINDS), seed=seed)
    model.fit(codes, gold, steps)
    return model


# ---------------------------------------------------------------- operator

_ITEM = "array<struct<kind:string,start:int,end:int,base:boolean,text:string>>"


def personal_data(docs: DataFrame, model: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): every span of each text, in order, with its kind, whether a base pattern found it, and its text."""
    out = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                              ("base", pa.bool_()), ("text", pa.string())]))

    def scan(texts: pa.Array) -> list:
        some = pc.fill_null(pc.match_substring_regex(texts, r"[0-9@]|[\[({<]\x20?[aA][tT]\x20?[\])}>]"), False)
        at = np.flatnonzero(some.to_numpy(zero_copy_only=False))
        held = texts.take(pa.array(at)).to_pylist()
        bases = [base_spans(t) for t in held]
        added = added_spans(held, bases, model)
        found: list[list] = [[] for _ in range(len(texts))]
        for r, t, b, a in zip(at, held, bases, added, strict=True):
            spans = sorted([(*s, True) for s in b] + [(*s, False) for s in a])
            found[r] = [{"kind": KINDS[k], "start": s, "end": e, "base": is_base, "text": t[s:e]} for s, k, e, is_base in spans]
        return [pa.array(found, out)]

    return map_text(docs, "spans " + _ITEM, scan, [id_col], text_col)


def digest(spans: str = "spans") -> list:
    """The count and digest columns of a spans column."""
    def joined(c):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda s: s["base"])
    counts = [count(k) for k in KINDS]
    return [*counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col(spans)).alias("spans")]


def op11_bilstm_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base counts and digest, and all spans."""
    docs = table(spark, sf_dir, "documents")
    return personal_data(docs, train(docs)).select("doc_id", *digest())
