"""Personal data: rules, and a character-level bidirectional LSTM with CRF transitions for what is written otherwise.

Nothing that the tagger may add (see valid) is without a digit, an @ or an "at" in brackets. Characters within REACH of one,
and the rest of the words that they lie in, are cut into overlapping windows; the rest of a text needs none. Each
window is decoded for itself. The spans of all windows are then reconciled over the whole text: spans that a window's
edge cuts are joined to those of the next window that they overlap, what several windows agree on counts once, and of
spans that overlap the set with the largest sum of probability times length is taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.bilstm_crf import KINDS, WIDTH, Tagger, char_ids, labelled, luhn

STRIDE, REACH = WIDTH // 2, 32
WORD = re.compile(r"\S*+")
#: Rows that a task holds as Python texts at a time.
ROWS = 512
SURE = 0.9
SPANS = "doc_id long, base array<struct<kind: string, start: int, end: int>>, added array<struct<kind: string, start: int, end: int>>"
AT, DOT = (re.compile(rf"\s*[\[({{]\s?{word}\s?[\])}}]\s*", re.IGNORECASE) for word in ("at", "dot"))
TRIGGER = re.compile(r"[0-9@]|[\[({]\s?at\s?[\])}]", re.IGNORECASE)
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*+")
HOST_END = re.compile(r"(?:[A-Za-z0-9-]|\.(?=[A-Za-z0-9-]))*+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NO_DIGIT = re.compile("[^0-9]")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """What the rules find, by kind and place.

    An address begins where the run of characters before its @ begins, or where the last one ended, and no run goes on
    beyond the @ before it; so every character is looked at a bounded number of times, in long runs too.
    """
    out, end = [], 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            after = max(end, text.rfind("@", end, m.start()) + 1)
            start = m.start() - LOCAL.match(text[after:m.start()][::-1]).end()
            if start < m.start():
                out.append(("email", start, m.end()))
                end = m.end()
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        for m in pattern.finditer(text):
            digits = NO_DIGIT.sub("", m[0])
            if (kind == "ip" and all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split("."))
                    or kind == "card" and 16 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15):
                out.append((kind, m.start(), m.end()))
    return out


def valid(kind: str, text: str) -> bool:
    """Whether what the tagger marks can be of that kind at all."""
    digits, tight = NO_DIGIT.sub("", text), "".join(text.split())
    if kind == "email":
        tight = "".join(DOT.sub(".", AT.sub("@", text)).split())
        return bool(DOMAIN.fullmatch(tight[tight.find("@"):])) and tight.count("@") == 1 and bool(LOCAL.fullmatch(tight[:tight.find("@")])) and tight[0] != "@"
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", tight)) and all(int(x) <= 255 for x in tight.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and len(set(digits)) > 1 and luhn(digits) and not re.search(r"[^0-9\s./-]", text)
    return 9 <= len(digits) <= 15 and not re.search(r"[^0-9\s()./+-]", text) and bool(re.search(r"[^0-9]", text.strip()))


def windows(text: str) -> list[tuple[int, int]]:
    """Overlapping windows over all characters within REACH of a trigger, and the rest of the words that these lie in."""
    out: list[tuple[int, int]] = []
    for m in TRIGGER.finditer(text):
        if out and m.end() <= out[-1][1] - REACH:
            continue
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            a = out.pop()[0]
        elif a:
            a -= WORD.match(text[out[-1][1] if out else 0:a][::-1]).end()  # what lies between two windows is looked at once
        out.append((a, WORD.match(text, b).end()))
    cut = []
    for lo, hi in out:
        at = lo
        while True:
            cut.append((at, min(at + WIDTH, len(text))))
            if at + WIDTH >= hi:
                break
            at += STRIDE
    return cut


def joined(found: list[tuple[str, int, int, float, bool, bool]]) -> list[tuple[str, int, int, float]]:
    """The spans (kind, start, end, probability, cut at its start, cut at its end) that no edge cuts, alone or joined.

    In the order of windows, a span cut at its end goes on in the next one of its kind that is cut at its start and
    overlaps it. Probabilities are averaged by length.
    """
    out, waiting = [], []
    for kind, start, end, sure, cut_start, cut_end in found:
        waiting = [w for w in waiting if w[2] > start]
        grown = [(kind, w[1], end, (w[3] * (w[2] - w[1]) + sure * (end - start)) / (w[2] - w[1] + end - start)) for w in waiting if cut_start and w[0] == kind and w[1] < start and w[2] <= end]
        grown = ([] if cut_start else [(kind, start, end, sure)]) + grown
        if cut_end:
            waiting += grown
        else:
            out += grown
    return out


def reconciled(found: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int]]:
    """The spans without overlaps that have the largest sum of probability times length."""
    best: dict[tuple[int, int], tuple[float, str]] = {}
    for kind, start, end, sure in found:
        best[start, end] = max(best.get((start, end), (0.0, "")), (sure, kind))
    order = sorted(best, key=lambda x: (x[1], x[0]))
    ends = [e for _, e in order]
    total, take = [0.0], []
    for i, (start, end) in enumerate(order):
        before = int(np.searchsorted(ends, start, "right"))
        gain = total[min(before, i)] + best[start, end][0] * (end - start)
        take.append((gain > total[i], min(before, i)))
        total.append(max(total[i], gain))
    out, i = [], len(order)
    while i:
        chosen, before = take[i - 1]
        if chosen:
            out.append((best[order[i - 1]][1], *order[i - 1]))
        i = before if chosen else i - 1
    return out[::-1]


def run_before(text: str, at: int) -> int:
    """Where the run of an address's characters that ends at a place begins; the look back doubles until it is there."""
    size = 64
    while True:
        low = max(0, at - size)
        begin = at - LOCAL.match(text[low:at][::-1]).end()
        if begin > low or not low:
            return begin
        size *= 2


def widened(text: str, kind: str, start: int, end: int, sure: float, runs: dict[str, tuple[int, int]] | None = None) -> tuple[str, int, int, float]:
    """The span without blanks at its ends. An address that begins or ends inside a run of its characters takes in the run.

    runs has the last run looked at before and behind a span, so that many spans in one long run cost no more than one.
    """
    start, end = end - len(text[start:end].lstrip()), start + len(text[start:end].rstrip())
    if kind != "email" or start >= end:
        return kind, start, end, sure
    runs = {} if runs is None else runs
    if not runs.get("before", (1, 0))[0] <= start <= runs.get("before", (1, 0))[1]:
        runs["before"] = (run_before(text, start), LOCAL.match(text, start).end())
    if not runs.get("behind", (1, 0))[0] <= end <= runs.get("behind", (1, 0))[1]:
        runs["behind"] = (end, HOST_END.match(text, end).end())
    return kind, runs["before"][0], runs["behind"][1], sure


def added_spans(texts: list[str], base: list[list[tuple[str, int, int]]], tagger: Tagger) -> list[list[tuple[str, int, int]]]:
    """What the tagger finds in each text beside the rules' spans."""
    cuts, owner = [], []
    for n, text in enumerate(texts):
        for a, b in windows(text):
            cuts.append((a, b))
            owner.append(n)
    decoded = tagger.spans([char_ids(texts[n][a:b]) for n, (a, b) in zip(owner, cuts, strict=True)])
    found: list[list[tuple[str, int, int, float, bool, bool]]] = [[] for _ in texts]
    for n, (a, b), spans in zip(owner, cuts, decoded, strict=True):
        found[n] += [(kind, a + start, a + end, sure, start == 0 and a > 0, end == b - a and b < len(texts[n])) for kind, start, end, sure in spans]
    out = []
    for text, text_found, known in zip(texts, found, base, strict=True):
        # of an address that an edge cuts the rest is its run, if the part at hand has what is around its @
        cut = [s[:4] for s in text_found if s[0] == "email" and (s[4] or s[5])]
        runs: dict[str, tuple[int, int]] = {}
        best: dict[tuple[str, int, int], float] = {}
        for kind, start, end, sure in (widened(text, *s, runs) for s in joined(text_found) + cut if s[3] >= SURE):
            best[kind, start, end] = max(sure, best.get((kind, start, end), 0.0))
        spans = reconciled([(*s, sure) for s, sure in best.items() if valid(s[0], text[s[1]:s[2]])])
        out.append([s for s in spans if all(s[2] <= a or s[1] >= b for _, a, b in known)])
    return out


@lru_cache(maxsize=2)
def trained(examples: int = 6000, steps: int = 500, batch: int = 32) -> Tagger:
    """The tagger, fitted on `examples` labelled texts in at most `steps` steps (fixed bounds; held-out accuracy is tested)."""
    tagger = Tagger()
    tagger.fit(labelled(examples, seed=1), steps, batch)
    return tagger


def by_kind(spans: list[tuple[str, int, int]]) -> list[dict]:
    return [{"kind": k, "start": a, "end": b} for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))]


def personal_data(docs: DataFrame, redact: bool = False, keep: list[str] | None = None) -> DataFrame:
    """SPANS for each document: what the rules find, and what the tagger adds, by kind and then place, in code points.

    With redact, also `text`: each span, or run of overlapping spans, replaced by its first kind in angle brackets (a null
    text stays null). Null and empty texts have no spans; rows are judged one by one, so repeated rows and null doc_ids
    need nothing more; an empty table gives an empty table. Columns named in `keep` go along as they are; others are not
    looked at. Texts are read whole.
    """
    tagger = trained()
    keep = keep or []
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *(F.col(c) for c in keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            texts = batch.column(1).to_pylist()
            base: list[list] = [[] for _ in texts]
            added: list[list] = [[] for _ in texts]
            some = [n for n, text in enumerate(texts) if text and TRIGGER.search(text)]
            known = [base_spans(texts[n]) for n in some]
            for n, k, more in zip(some, known, added_spans([texts[n] for n in some], known, tagger), strict=True):
                base[n], added[n] = k, more
            columns = [batch.column(0), pa.array([by_kind(x) for x in base], span), pa.array([by_kind(x) for x in added], span)]
            if redact:
                for n in some:
                    if spans := sorted(base[n] + added[n], key=lambda s: (s[1], -s[2])):
                        texts[n] = redacted(texts[n], spans)
                columns.append(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns[2:]], names=["doc_id", "base", "added"] + ["text"] * redact + keep)

    kept = "".join(f", `{c}` {own.schema[c].dataType.simpleString()}" for c in keep)
    return own.mapInArrow(run, SPANS + ", text string" * redact + kept)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at, end = [], 0, -1
    for kind, a, b in spans:
        if a >= end:
            out += [text[at:a], f"<{kind.upper()}>"]
            at = end = b
        elif b > end:
            at = end = b
    return "".join(out) + text[at:]
