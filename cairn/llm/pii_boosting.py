"""Personal data: wide candidate generators, judged by gradient-boosted trees on format and context.

Spans of four fixed formats are found exactly. Beside them, generators propose every stretch that might be
a national telephone number, an account number, an identity number, a birth date or a disguised mail
address; proposals may overlap. Boosted trees score each from its format and the words before it, a
threshold calibrated on held-out samples for each kind accepts, and the best of overlapping ones stays.

Only stretches around digits, account starts, @ and bracketed "at" are looked at with regular expressions: the matches of a
format lie within runs of its characters, so runs found on the bytes give the same matches as whole texts.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm import kernels as K
from cairn.llm.spans import free_names, masked

# Fixed formats of the contract. An address is looked for from its @, and an ip from the first of its digits, so that
# long runs of letters or digits are read once and not from each of their places.
DOMAIN = re.compile(rb"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(rb"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(rb"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
BASE_KINDS = ["email", "ip", "card", "phone"]
ADDED_KINDS = ["national", "account", "identity", "birth", "mail"]
RANK = {k: i for i, k in enumerate(BASE_KINDS + ADDED_KINDS)}
# Generators of proposals within a run of digits and signs, by kind.
PROPOSE = {
    "national": re.compile(rb"\(?[0-9]{2,5}\)?(?:[\x20./-]?[0-9]{2,5}){1,4}"),
    "identity": re.compile(rb"[0-9]{3}[\x20-]?[0-9]{2}[\x20-]?[0-9]{4}"),
    "birth": re.compile(rb"[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{2,4}"),
}
ACCOUNT = re.compile(rb"[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]){11,30}")
AT = re.compile(rb"[\[(][\x20]?at[\x20]?[\])]")
MAIL = re.compile(rb"[A-Za-z0-9._%+-]{1,64}[\x20]?[\[(][\x20]?at[\x20]?[\])][\x20]?[A-Za-z0-9-]{1,63}(?:[\x20]?(?:\.|[\[(][\x20]?dot[\x20]?[\])])[\x20]?[A-Za-z0-9-]{1,63})+")
CUES = [rb"phone|tel|call|mobile|fax|cell|tf", rb"iban|bank|account|konto|cuenta|compte", rb"ssn|social|passport|national id|ident|tax", rb"born|birth|dob|geboren|nacid|n[\xc3]?[\xa9e]? le", rb"mail|contact|write|reach"]
COUNTER = [rb"version|release|build|v\.", rb"order|invoice|ticket|item|sku|serial|ref", rb"isbn|issn|doi|page|vol|no\.|chapter", rb"\$|\xe2\x82\xac|eur|usd|price|total|cost|sum", rb"published|updated|date|on the|until|since"]
CONTEXT = [re.compile(x) for x in CUES + COUNTER]
N_FEATURES = 14 + len(CONTEXT)
IN_MAIL = np.zeros(256, bool)
IN_MAIL[[*range(48, 58), *range(65, 91), *range(97, 123), *b"._%+-@"]] = True
IN_RUN = np.zeros(256, bool)
IN_RUN[[*range(48, 58), *b" ().-/+"]] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def only_digits(x: bytes) -> bytes:
    return bytes(c for c in x if 48 <= c < 58)


def base_in_run(run: bytes) -> Iterator[tuple[str, int, int]]:
    """ip, card and phone spans of a run."""
    for m in IP.finditer(run):
        if all(len(p) <= 3 and int(p or b"0") <= 255 for p in (x.lstrip(b"0") for x in m[0].split(b"."))):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(run):
        digits = only_digits(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    for m in PHONE.finditer(run):
        if 9 <= len(only_digits(m[0])) <= 15:
            yield "phone", m.start(), m.end()


def emails_in(run: bytes) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses of a run of mail characters: a local part reaches back to the last @ or match."""
    floor = 0
    at = run.find(b"@")
    while at >= 0:
        m = DOMAIN.match(run, at + 1) if at > floor else None
        if m:
            yield floor, m.end()
        floor = m.end() if m else at + 1
        at = run.find(b"@", floor)


class Taken:
    """Stretches of one document that are taken, apart from each other, in order."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def add(self, start: int, end: int) -> bool:
        """Take start to end if it is free."""
        k = bisect_right(self.starts, start)
        if (k and self.ends[k - 1] > start) or (k < len(self.starts) and self.starts[k] < end):
            return False
        self.starts.insert(k, start)
        self.ends.insert(k, end)
        return True


def mod97(x: bytes) -> bool:
    text = bytes(c for c in x if c != 32)
    moved = text[4:] + text[:4]
    return int("".join(str(int(chr(c), 36)) for c in moved)) % 97 == 1


def features(kind: str, span: bytes, before: bytes, after: bytes) -> list[float]:
    digits = only_digits(span)
    groups = re.split(rb"[^0-9A-Za-z]+", span)
    year = re.search(rb"(?:19|20)[0-9]{2}", span)
    low = before.lower()
    out = [
        ADDED_KINDS.index(kind), len(span), len(digits), len(groups), max(map(len, groups)), min(map(len, groups)), len(set(digits)),
        span.count(b" "), span.count(b"-"), span.count(b".") + 10 * span.count(b"/"),
        float(kind == "account" and mod97(span)), float(bool(year)), float(before[-1:].isalnum()), float(after[:1].isalnum() or after[:1] in (b"-", b"/")),
    ]
    for cue in CONTEXT:
        found = [m.end() for m in cue.finditer(low)]
        out.append(float(len(low) - found[-1]) if found else 99.0)
    return out


@dataclass
class Trees:
    """Trees of depth 3 as arrays: a row has the features and limits of seven splits, and eight leaf values."""

    start: float
    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(3):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            z += leaf[node - 7]
        return 1 / (1 + np.exp(-z))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.3) -> Trees:
    """Newton boosting of the logistic loss; splits are tried at up to 16 quantiles of each feature."""
    limits = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 17)[:-1])) for f in range(x.shape[1])]
    start = float(np.log(y.mean() / (1 - y.mean())))
    z = np.full(len(x), start)
    trees: list[tuple] = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        feature, limit, node = np.zeros(7, int), np.full(7, np.inf), np.zeros(len(x), int)
        for k in range(7):
            at = np.flatnonzero(node == k)
            best = 1e-6
            for f in range(x.shape[1]):
                above = x[at, f][:, None] > limits[f]
                gr, hr = g[at] @ above, h[at] @ above
                gl, hl = g[at].sum() - gr, h[at].sum() - hr
                gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g[at].sum() ** 2 / (h[at].sum() + 1)
                i = int(np.argmax(gain)) if len(gain) else 0
                if len(at) and gain[i] > best:
                    best, feature[k], limit[k] = gain[i], f, limits[f][i]
            node[at] = 2 * k + 1 + (x[at, feature[k]] > limit[k])
        leaf = np.array([rate * g[node == k + 7].sum() / (h[node == k + 7].sum() + 1) for k in range(8)])
        z += leaf[node - 7]
        trees.append((feature, limit, leaf))
    return Trees(start, *(np.array(c) for c in zip(*trees, strict=True)))


# Words before and around spans in the samples that thresholds are calibrated on: none is a phrase of the training samples.
OTHER_GOOD = [["reach me on ", "cell ", "my new mobile number is ", "tel: "], ["please transfer to ", "my iban: ", "compte ", "cuenta "], ["passport no ", "tax id ", "social sec. ", "identity card "], ["birthday ", "she was born ", "nacido el ", "geboren: "], ["e-mail ", "reach us: ", "contact: ", "mail me at "]]
OTHER_BAD = [["item ", "part no. ", "doi ", "a count of ", "series "], ["v. ", "build no. ", "firmware "], ["since ", "on the ", "minutes of ", "dated "], ["cost eur ", "a price of ", "balance "], ["hash ", "locker ", "unit "], ["chapters ", "years ", "rows "]]
OTHER_WORDS = "but our all can her one day out see new now old two way who its did get may him had own any say she".split()


def labelled(seed: int = 3, rows: int = 3000, other: bool = False) -> Iterator[tuple[int, bytes]]:
    """(label, text with the span between \\x02 and \\x03): made-up personal data in its usual words, and numbers that are none.

    other takes the phrases and words of the second set.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda xs: xs[int(rng.integers(len(xs)))]

    def account() -> str:
        country = pick(["DE", "FR", "ES", "GB", "NL"])
        # the bank is four letters in GB and NL
        bank = "".join(chr(65 + int(k)) for k in rng.integers(0, 26, 4)) if country in ("GB", "NL") else ""
        body = bank + digits({"GB": 14, "NL": 10}.get(country, 18))
        check = 98 - int("".join(str(int(c, 36)) for c in body + country) + "00") % 97
        text = f"{country}{check:02d}{body}"
        return " ".join(text[i : i + 4] for i in range(0, len(text), 4)) if rng.random() < 0.5 else text

    date = lambda: pick(["{0:02d}/{1:02d}/{2}", "{1}.{0}.{2}", "{2}-{0:02d}-{1:02d}"]).format(int(rng.integers(1, 13)), int(rng.integers(1, 29)), int(rng.integers(1940, 2012)))
    phone = lambda: pick(["({}) {}-{}", "{}-{}-{}", "{} {} {}", "{}/{}{}"]).format("0" + digits(2) if rng.random() < 0.4 else digits(3), digits(3), digits(4))
    mail = lambda: f"{pick(['ann', 'j.doe', 'team42', 'max'])}{pick([' ', ''])}{pick(['(at)', '[at]'])}{pick([' ', ''])}{pick(['mail', 'post', 'web'])}{pick(['.', ' [dot] ', '(dot)'])}{pick(['com', 'org', 'de'])}"
    good = [(["call me at ", "phone: ", "tel. ", "mobile ", "fax "], phone), (["iban ", "bank account ", "konto ", ""], account), (["ssn ", "social security number ", "passport ", "national id "], lambda: pick(["{}-{}-{}", "{} {} {}"]).format(digits(3), digits(2), digits(4))),
            (["born on ", "date of birth: ", "dob ", "geboren am "], date), (["mail ", "contact ", "write to ", ""], mail)]
    bad = [(["order ", "invoice no. ", "ticket ", "the ", "serial ", "isbn "], lambda: pick([phone, lambda: digits(int(rng.integers(7, 14))), lambda: f"{digits(3)}-{digits(1)}-{digits(4)}-{digits(3)}"])()), (["version ", "release ", "build "], lambda: f"{digits(2)}.{digits(2)}.{digits(4)}"),
           (["published on ", "updated ", "until ", "the ", "meeting on "], date), (["total ", "price $", "sum of "], lambda: f"{digits(3)}.{digits(3)}.{digits(2)}"), (["code ", "sku ", "ref ", ""], lambda: f"{pick(['AB', 'XK', 'ZZ'])}{digits(16)}"), (["lines ", "pages ", "and "], lambda: f"{digits(4)}-{digits(4)}")]
    filler = OTHER_WORDS if other else "the and of to in was with for it on as at by from were that this which".split()
    if other:
        good, bad = ([(leads, make) for leads, (_, make) in zip(phrases, kinds, strict=True)] for phrases, kinds in ((OTHER_GOOD, good), (OTHER_BAD, bad)))
    for _ in range(rows):
        label = int(rng.random() < 0.5)
        leads, make = pick(good if label else bad)
        words = lambda: " ".join(pick(filler) for _ in range(int(rng.integers(2, 8))))
        yield label, f"{words()} {pick(leads)}\x02{make()}\x03{pick([' ', '. ', ', '])}{words()}".encode()


def account_starts(data: np.ndarray) -> list[int]:
    """Places of two capitals before two digits."""
    if len(data) < 4:
        return []
    up, digit = UPPER[data], DIGIT[data]
    return np.flatnonzero(up[:-3] & up[1:-2] & digit[2:-1] & digit[3:]).tolist()


def proposals(data: bytes, runs: list[tuple[int, int]], ats: list[int], starts: list[int], offsets: np.ndarray) -> Iterator[tuple[str, int, int]]:
    """Proposals in the documents that offsets bound; none reaches over a bound, so each document has its own whatever lies beside it."""
    bounds = lambda at: tuple(offsets[(k := int(np.searchsorted(offsets, at, "right"))) - 1 : k + 1].tolist())
    for a, b in runs:
        run = data[a:b]
        for kind, pattern in PROPOSE.items():
            for m in pattern.finditer(run):
                if kind == "birth" or len(only_digits(m[0])) >= 7:
                    yield kind, a + m.start(), a + m.end()
    for a in starts:
        floor, ceiling = bounds(a)
        if a > floor and data[a - 1 : a].isalnum():
            continue
        m = ACCOUNT.match(data, a, ceiling)
        if m:
            yield "account", m.start(), m.end()
            # words in capitals may follow the number: what is right up to a blank is proposed too
            for blank in re.finditer(b" ", m[0]):
                part = m[0][: blank.start()]
                if len(part) - part.count(b" ") >= 15 and mod97(part):
                    yield "account", a, a + len(part)
    for at in ats:
        floor, ceiling = bounds(at)
        for m in MAIL.finditer(data, max(floor, at - 70), min(ceiling, at + 140)):
            if m.start() <= at < m.end():
                yield "mail", m.start(), m.end()


def judged_samples(samples: Iterator[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, whether it is right, kind) of every proposal in the samples: right if it covers a labelled span but for two signs."""
    rows, labels, kinds = [], [], []
    for label, text in samples:
        a, b = text.index(b"\x02"), text.index(b"\x03") - 1
        text = text.replace(b"\x02", b"").replace(b"\x03", b"")
        data = np.frombuffer(text, np.uint8)
        offsets = np.array([0, len(data)])
        runs, _, ats = stretches(data, offsets)
        for kind, start, end in proposals(text, runs, ats, account_starts(data), offsets):
            right = label and start <= a + 2 and end >= b - 2 and start < b and end > a
            rows.append(features(kind, text[start:end], text[max(0, start - 40) : start], text[end : end + 3]))
            labels.append(float(bool(right)))
            kinds.append(kind)
    return np.array(rows), np.array(labels), np.array(kinds)


@functools.lru_cache(1)
def trained() -> tuple[Trees, dict[str, float]]:
    """The trees, and for each kind the least threshold at which at most 2 % of what is accepted of the calibration samples is false.

    Those are made with other phrases and words than the training samples. A kind for which no threshold does keeps the highest probability met.
    """
    x, y, _ = judged_samples(labelled())
    trees = boost(x, y)
    x, y, kinds = judged_samples(labelled(seed=8, rows=2000, other=True))
    p = trees.probability(x)
    least = {}
    for kind in ADDED_KINDS:
        order = np.flatnonzero(kinds == kind)
        order = order[np.argsort(-p[order], kind="stable")]
        false = np.cumsum(y[order] == 0) / np.arange(1, len(order) + 1)
        # equal probabilities are accepted together
        last = np.append(p[order][1:] != p[order][:-1], True) if len(order) else np.zeros(0, bool)
        good = np.flatnonzero((false <= 0.02) & last)
        least[kind] = float(max(0.2, p[order[good[-1]]])) if len(good) else float(max(0.99, p[order].max(initial=0.99)))
    return trees, least


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int]], list[int]]:
    """Runs of digits and signs with four digits or more, runs of mail characters with an @, and places of a bracketed "at"."""
    doc_of = lambda at: np.searchsorted(offsets, at, "right")
    digit = np.flatnonzero(DIGIT[data])
    runs: list[tuple[int, int]] = []
    if len(digit):
        walls = np.cumsum(~IN_RUN[data])[digit] * 2
        fresh = np.ones(len(digit), bool)
        fresh[1:] = (walls[1:] != walls[:-1]) | (doc_of(digit[1:]) != doc_of(digit[:-1]))
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(digit)) - 1
        many = last - first >= 3
        for a, b in zip(digit[first[many]].tolist(), digit[last[many]].tolist(), strict=True):
            floor = int(offsets[doc_of(a) - 1])
            while a > floor and data[a - 1] in b"+(":
                a -= 1
            runs.append((a, b + 1))
    mails: list[tuple[int, int]] = []
    for at in np.flatnonzero(data == 64).tolist():
        if mails and at < mails[-1][1]:
            continue
        floor, ceiling = int(offsets[doc_of(at) - 1]), int(offsets[doc_of(at)])
        a, b = at, at + 1
        while a > floor and IN_MAIL[data[a - 1]]:
            a -= 1
        while b < ceiling and IN_MAIL[data[b]]:
            b += 1
        mails.append((a, b))
    return runs, mails, [m.start() for m in AT.finditer(data.tobytes())]


def spans_of(data: np.ndarray, offsets: np.ndarray, trees: Trees, least: dict[str, float]) -> tuple[list[tuple], list[tuple]]:
    """(document, start, end, kind) in bytes of the slice: spans of the fixed formats, and accepted proposals apart from them."""
    text = data.tobytes()
    runs, mails, ats = stretches(data, offsets)
    doc_of = lambda at: int(np.searchsorted(offsets, at, "right")) - 1
    base = [(doc_of(a), a + s, a + e, kind) for a, b in runs for kind, s, e in base_in_run(text[a:b])]
    base += [(doc_of(a), a + s, a + e, "email") for a, b in mails for s, e in emails_in(text[a:b])]
    some, rows = [], []
    for kind, start, end in proposals(text, runs, ats, account_starts(data), offsets):
        doc = doc_of(start)
        floor, ceiling = int(offsets[doc]), int(offsets[doc + 1])
        some.append((doc, start, end, kind))
        rows.append(features(kind, text[start:end], text[max(floor, start - 40) : start], text[end : min(ceiling, end + 3)]))
    added: list[tuple] = []
    if some:
        p = trees.probability(np.array(rows))
        good = np.flatnonzero(p >= np.array([least[x[3]] for x in some]))
        fixed: dict[int, list[tuple[int, int]]] = {some[i][0]: [] for i in good}
        for doc, start, end, _ in base:
            if doc in fixed:
                fixed[doc].append((start, end))
        taken = {doc: Taken(spans) for doc, spans in fixed.items()}
        for i in good[np.argsort(-p[good], kind="stable")]:
            doc, start, end, _ = some[i]
            if taken[doc].add(start, end):
                added.append(some[i])
    return base, added


def with_spans(docs: DataFrame, text: str = "text", names: tuple[str, str] = ("base", "added")) -> DataFrame:
    """docs with base and added: arrays of (start, end, rank, kind) in code points, end exclusive, by start and rank.

    A null text counts as empty and has no spans; repeated rows are scanned each; an empty table gives no
    rows. Columns of docs named like a new one, in any case, are replaced; names gives the new ones other names.
    A text is held whole by its task, with some tens of bytes for each run of digits in it.
    """
    trees, least = trained()
    columns = [c for c in docs.columns if c.lower() not in (x.lower() for x in names)]
    at_text = columns.index(text)
    kind = T.ArrayType(T.StructType().add("start", T.LongType()).add("end", T.LongType()).add("rank", T.IntegerType()).add("kind", T.StringType()))
    schema = T.StructType([docs.schema[c] for c in columns] + [T.StructField(c, kind) for c in names])
    item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("rank", pa.int32()), ("kind", pa.string())])

    def listed(found: list[tuple], points: np.ndarray, offsets: np.ndarray) -> pa.Array:
        found = sorted((d, int(points[s] - points[offsets[d]]), int(points[e] - points[offsets[d]]), RANK[k], k) for d, s, e, k in found)
        found = sorted(found, key=lambda x: (x[0], x[1], x[3]))
        bounds = np.searchsorted(np.array([x[0] for x in found], np.int64), np.arange(len(offsets)))
        values = pa.array([{"start": s, "end": e, "rank": r, "kind": k} for _, s, e, r, k in found], item)
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_bytes(batch.column(at_text))
            for i, j in K.slices(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                points = np.zeros(len(part) + 1, np.int64)
                np.cumsum((part & 0xC0) != 0x80, out=points[1:])
                base, added = spans_of(part, at, trees, least)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns), listed(base, points, at), listed(added, points, at)], [*columns, *names])

    return docs.select(columns).mapInArrow(run, schema)


def redact(docs: DataFrame, text: str = "text", mark: str = "[PII]") -> DataFrame:
    """docs with every span of the text, of either sort, replaced by mark; other columns stay as they are, whatever their names."""
    base, added = free_names(docs, "base", "added")
    return with_spans(docs, text, (base, added)).withColumn(text, masked(F.col(text), F.concat(base, added), mark)).select(docs.columns)
