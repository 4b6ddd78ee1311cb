"""Secret scans: candidates by shape, false positives removed by a random forest over what they look like and where they stand."""

from __future__ import annotations

import hashlib
import math
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, positional, trimmed

#: Labelled findings that the forest is fitted on (half of them secrets), its size, and the vote from which a finding counts.
FINDINGS, TREES, DEPTH, VOTE, SEED = 6000, 31, 9, 0.5, 11
SHORTEST, LEFT = 8, 32
MASK = "[SECRET]"

#: Starts of issued keys, words before secrets, words before harmless tokens, and common parts of words.
PREFIXES = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "github_pat_", "glpat-", "sk-", "sk_live_", "rk_live_", "xoxb-", "xoxp-", "npm_", "pypi-", "eyJ", "SG.", "hf_")
SECRET_WORDS = ("password", "passwd", "pwd", "passphrase", "secret", "token", "apikey", "api_key", "api-key", "access_key", "auth", "bearer", "credential", "private_key")
HARMLESS_WORDS = ("sha", "md5", "commit", "uuid", "guid", "checksum", "digest", "etag", "version", "isbn", "issn", "doi", "page", "ref", "card", "iban", "tel", "phone", "order", "invoice", "file", "path", "build", "model", "serial")
DICTIONARY = (
    "able", "about", "account", "admin", "after", "app", "article", "auto", "back", "base", "before", "block", "book", "build", "case", "change", "chapter", "class",
    "client", "code", "com", "config", "content", "count", "data", "date", "day", "default", "demo", "detail", "dev", "device", "document", "en", "end", "ent", "er", "error",
    "es", "example", "file", "first", "for", "form", "from", "group", "guide", "home", "html", "http", "image", "index", "info", "ing", "ion", "item", "key", "last", "level",
    "line", "link", "list", "log", "mail", "main", "map", "ment", "message", "model", "month", "name", "net", "new", "node", "note", "number", "of", "on", "order", "org",
    "page", "part", "path", "photo", "post", "product", "project", "re", "release", "report", "result", "section", "server", "service", "session", "set", "site", "sample",
    "start", "state", "step", "story", "summer", "system", "table", "test", "text", "the", "time", "tion", "title", "type", "update", "user", "value", "version", "video",
    "view", "week", "winter", "word", "work", "year",
)

_RUN = "A-Za-z0-9_+/.~-"
_DIGIT = re.compile(r"[0-9]")
_BEFORE = re.compile(f"[{_RUN}]*\\Z")
_AFTER = re.compile(f"[{_RUN}]*=*")
_ASSIGNED = re.compile(r"""(?i)(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key)["']?[ \t]{0,3}[:=][ \t]{0,3}["']?([^\s"'<>]{6,})""")
_ISSUED = re.compile(f"(?<![{_RUN}])(?:{'|'.join(map(re.escape, PREFIXES))})[{_RUN}]{{12,}}")
_WORDS = re.compile("|".join(sorted(DICTIONARY, key=len, reverse=True)))
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\Z")
_DATE = re.compile(r"\d{4}[-/.]\d{2}[-/.]\d{2}|\d{1,2}[./]\d{1,2}[./]\d{2,4}")
_EXTENSION = re.compile(r"\.[a-z]{1,4}\d?\Z")


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of what may be a secret: values assigned to telling names, issued keys by their starts, and runs of
    key characters of at least eight that have a digit and a letter, which are found around digits."""
    spans: dict[int, int] = {}
    for m in _ASSIGNED.finditer(text):
        value = m[1].rstrip(".,;:!?)]}")
        if len(value) >= 6:
            spans[m.start(1)] = m.start(1) + len(value)
    for m in _ISSUED.finditer(text):
        if not any(s <= m.start() < e for s, e in spans.items()):
            spans[m.start()] = m.start() + len(m[0].rstrip(".-_/~"))
    taken = sorted(spans.items())
    at = k = 0
    while m := _DIGIT.search(text, at):
        start = lo = m.start()
        while start == lo > at:  # as far as the run goes, a stretch at a time
            lo = max(at, start - 4096)
            start = lo + _BEFORE.search(text[lo:start]).start()
        end = _AFTER.match(text, m.start()).end()
        at = end
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if k < len(taken) and taken[k][0] < end:
            continue
        value = text[start:end].rstrip(".-_/~").lstrip(".-_/~+")
        start = text.index(value, start) if value else start
        if len(value) >= SHORTEST and any(c.isalpha() for c in value):
            spans[start] = start + len(value)
    return sorted(spans.items())


def features(value: str, before: str, after: str) -> list[float]:
    """Length, character mix and transitions, dictionary coverage, path traits and neighbouring words."""
    n = len(value)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in value]
    share = {k: kinds.count(k) / n for k in "duls"}
    changes = sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1)
    counts: dict[str, int] = {}
    for c in value:
        counts[c] = counts.get(c, 0) + 1
    entropy = -sum(x / n * math.log2(x / n) for x in counts.values())
    low = value.lower()
    vowels = [c in "aeiouy" for c in low if c.isalpha()]
    swings = sum(a != b for a, b in zip(vowels, vowels[1:])) / max(1, len(vowels) - 1)
    covered = sum(len(w) for w in _WORDS.findall(low)) / n
    left, words = before.lower(), before.lower().split()
    near = " ".join(words[-3:])
    runs = re.findall(r"\d+|[A-Za-z]+", value)
    return [
        n, share["d"], share["u"], share["l"], share["s"], changes, entropy, entropy / max(1.0, math.log2(n)), swings, covered,
        float(all(c in "0123456789abcdef" for c in value)), float(any(value.startswith(p) for p in PREFIXES)), float(bool(_UUID.match(value))),
        float(bool(_DATE.search(value))), value.count("/") / n, value.count("."), float(bool(_EXTENSION.search(low))),
        float("://" in before[-12:] or "www." in low or before.endswith("@") or after.startswith("@")),
        float(any(w in near for w in SECRET_WORDS)), float(any(w in near for w in HARMLESS_WORDS)), float(left.rstrip("\"' ").endswith(("=", ":"))),
        float(before[-1:] in "\"'`" and before != ""), max(map(len, runs), default=0) / n, len(runs),
    ]


def labelled(n: int, seed: int) -> list[tuple[str, str, str, int]]:
    """n findings (value, before, after, secret or not): issued keys, passwords and random tokens against hashes,
    identifiers, paths, dates, versions, numbers, compound words and the like, all drawn from a seed."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choices(chars, k=k))
    hexa, upper, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    syllables = ("an", "be", "der", "en", "er", "est", "ing", "ion", "la", "ment", "on", "re", "st", "th", "tion", "ver", "ca", "do", "el", "os")
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4))) if r.random() < 0.6 else r.choice(DICTIONARY)
    prose = lambda: " ".join(word() for _ in range(4)) + " "
    assign = lambda names: f"{prose()}{r.choice(names)}{r.choice(('=', ': ', ' = ', ' = \"', '=\"', ': \''))}"

    def secret() -> tuple[str, str]:
        kind = r.randrange(7)
        if kind == 0:
            return r.choice(("AKIA", "ASIA")) + pick(upper, 16), prose() if r.random() < 0.7 else assign(("key", "access_key"))
        if kind == 1:
            return r.choice(("ghp_", "gho_", "glpat-", "sk-", "sk_live_", "npm_", "hf_", "AIza")) + pick(mixed, r.randint(20, 48)), prose() if r.random() < 0.6 else assign(SECRET_WORDS)
        if kind == 2:
            return pick(hexa, r.choice((16, 18, 20, 24, 32, 40, 64))), assign(SECRET_WORDS)
        if kind == 3:
            return pick(mixed + "+/", r.randint(20, 64)), assign(SECRET_WORDS)
        if kind == 4:
            return pick(mixed + "!#%&*-_", r.randint(8, 20)), assign(("password", "passwd", "pwd", "passphrase", "secret"))
        if kind == 5:
            return "eyJ" + pick(mixed + "-_", r.randint(12, 30)) + "." + pick(mixed + "-_", r.randint(20, 60)) + "." + pick(mixed + "-_", 43), prose() + r.choice(("", "bearer ", "token: "))
        return pick(mixed, r.randint(24, 48)), prose() + r.choice(SECRET_WORDS) + " "

    def harmless() -> tuple[str, str]:
        kind = r.randrange(14)
        number = lambda k: pick("0123456789", k)
        if kind == 0:
            return pick(hexa, r.choice((32, 40, 64))), prose() + r.choice(("sha ", "sha256:", "md5 ", "commit ", "checksum: ", "etag=", "digest "))
        if kind == 1:
            x = pick(hexa, 32)
            return "-".join((x[:8], x[8:12], x[12:16], x[16:20], x[20:])), prose() + r.choice(("", "uuid ", "id=", "id: ", "token: "))
        if kind == 2:
            return "/".join(word() for _ in range(r.randint(2, 5))) + "/" + word() + number(r.randint(1, 4)) + r.choice((".html", ".py", ".jpg", "", ".mp3")), prose() + r.choice(("", "https://", "file: ", "path="))
        if kind == 3:
            return f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}" + r.choice(("T12", "T08:00Z", "a")), prose()
        if kind == 4:
            return f"v{r.randint(0, 20)}.{r.randint(0, 30)}.{r.randint(0, 99)}" + r.choice(("-beta", "-rc1", "rc2", "-alpha.1")), prose() + r.choice(("", "version "))
        if kind == 5:
            return word() + r.choice(("", "-", "_")) + word() + r.choice(("", "-", "_")) + number(r.randint(1, 6)), prose()
        if kind == 6:
            return word().capitalize() + word() + number(r.randint(1, 3)) + word().capitalize(), prose()
        if kind == 7:
            return r.choice(("CH", "DE", "FR", "ES")) + number(r.choice((18, 19, 20))), prose() + r.choice(("iban ", ""))
        if kind == 8:
            return word() + "." + word() + number(2), prose() + r.choice(("", "mail "))
        if kind == 9:
            return r.choice(("your", "my", "change", "insert", "example")) + r.choice(("_", "-", "")) + r.choice(("password", "token", "secret", "key")) + r.choice(("", "1", "123", "_here", "-here")), assign(SECRET_WORDS)
        if kind == 10:
            return r.choice("x*X0") * r.randint(8, 24) + r.choice(("", "a1")), assign(SECRET_WORDS)
        if kind == 11:
            return word() + word() + word() + number(1) + word(), prose()
        if kind == 12:
            return r.choice(("$", "%", "")) + r.choice(("{", "(", "")) + word().upper() + "_" + r.choice(("PASSWORD", "TOKEN", "KEY")), assign(SECRET_WORDS)
        return r.choice(("ISBN", "No", "Nr", "A", "RFC", "Model")) + "-" + number(r.randint(4, 10)) + r.choice(("", "X", "b")), prose() + r.choice(("isbn ", "serial ", "invoice ", "order ", ""))

    out = []
    for k in range(n):
        value, before = (secret if k % 2 else harmless)()
        quoted = before[-1:] in "\"'"
        out.append((value, before[-LEFT:], (before[-1] if quoted else " ") + prose()[:8], k % 2))
    return out


class Forest:
    """Random forest of binary trees over numbers: bootstrap rows, a random third of the features at each node, Gini splits."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            rows = draw.integers(0, len(x), len(x))
            self.trees.append(self._grow(x[rows], y[rows], depth, draw))

    @staticmethod
    def _grow(x: np.ndarray, y: np.ndarray, depth: int, draw: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, share = [], [], [], [], []

        def node(rows: np.ndarray, depth: int) -> int:
            me = len(feature)
            part = y[rows]
            for column, value in ((feature, -1), (cut, 0.0), (left, me), (right, me), (share, part.mean())):
                column.append(value)
            if depth and len(rows) >= 8 and 0 < share[me] < 1:
                best = (part.var() * len(rows) - 1e-9, -1, 0.0)
                for f in draw.choice(x.shape[1], max(1, x.shape[1] // 3), replace=False):
                    v = x[rows, f]
                    order = np.argsort(v, kind="stable")
                    v, ones = v[order], np.cumsum(part[order])
                    places = np.flatnonzero(v[1:] > v[:-1])
                    if len(places):
                        n, k = len(rows), places + 1
                        a, b = ones[places], ones[-1] - ones[places]
                        impurity = a * (k - a) / k + b * (n - k - b) / (n - k)
                        at = int(np.argmin(impurity))
                        if impurity[at] < best[0]:
                            best = (float(impurity[at]), int(f), float(v[places[at]]))
                if best[1] >= 0:
                    feature[me], cut[me] = best[1], best[2]
                    goes = x[rows, best[1]] <= best[2]
                    left[me] = node(rows[goes], depth - 1)
                    right[me] = node(rows[~goes], depth - 1)
            return me

        node(np.arange(len(x)), depth)
        return tuple(map(np.array, (feature, cut, left, right, share)))

    def vote(self, x: np.ndarray) -> np.ndarray:
        """Mean share of secrets in the leaves that each row falls into."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, left, right, share in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[at]
                inner = f >= 0
                goes = x[rows, np.maximum(f, 0)] <= cut[at]
                at = np.where(inner, np.where(goes, left[at], right[at]), at)
            total += share[at]
        return total / len(self.trees)


@lru_cache(maxsize=4)
def trained(findings: int = FINDINGS, seed: int = SEED) -> Forest:
    rows = labelled(findings, seed)
    return Forest(np.array([features(*r[:3]) for r in rows]), np.array([r[3] for r in rows], float), seed=seed)


def scan_text(texts: list[str], forest: Forest) -> list[list[tuple[int, int, float]]]:
    """(start, end, vote) of the candidates of each text."""
    spans = [candidates(t) for t in texts]
    rows = [features(t[s:e], t[max(0, s - LEFT) : s], t[e : e + 8]) for t, x in zip(texts, spans, strict=True) for s, e in x]
    votes = iter(forest.vote(np.array(rows)).tolist() if rows else ())
    return [[(s, e, next(votes)) for s, e in x] for x in spans]


def secret_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", forest: Forest | None = None) -> DataFrame:
    """One row per finding: id, start, end (code points), sha256 (of the finding, which itself is not returned), vote
    (rounded to 6 places), is_secret.

    Defined cases: null and empty texts have no findings; texts are read whole; repeated rows give their findings each;
    an empty table gives no rows; other columns are ignored whatever their names; a vote of exactly VOTE is a secret.
    """
    forest = forest or trained()
    kind = df.schema[id_col].dataType.simpleString()

    def scan(batches):
        for batch in batches:
            for at, to in by_size(batch.column(1)):
                texts = [t or "" for t in batch.column(1).slice(at, to - at).to_pylist()]
                owner, rows = [], []
                for k, found in enumerate(scan_text(texts, forest)):
                    for s, e, vote in found:
                        owner.append(at + k)
                        vote = round(vote, 6)
                        rows.append((s, e, hashlib.sha256(texts[k][s:e].encode()).hexdigest(), vote, vote >= VOTE))
                if rows:
                    cells = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_()), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), *cells], names=["id", "start", "end", "sha256", "vote", "is_secret"])

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(trimmed(scan), f"id {kind}, start long, end long, sha256 string, vote double, is_secret boolean")
    return out.withColumnRenamed("id", id_col)


def redact(df: DataFrame, text_col: str = "text", count_col: str | None = "n_chars", forest: Forest | None = None) -> DataFrame:
    """df with every secret of the texts replaced by MASK; a column of that name counts the new text's characters.

    Rows stay as they are in number and order; null texts stay null. The cases are those of secret_scan().
    """
    forest = forest or trained()
    place = df.columns.index(text_col)
    cells = positional(df)

    def mask(batches):
        for batch in batches:
            for at, to in by_size(batch.column(place)):
                part, out = batch.slice(at, to - at), []
                texts = part.column(place).to_pylist()
                for text, found in zip(texts, scan_text([t or "" for t in texts], forest), strict=True):
                    pieces, end = [], 0
                    for s, e, vote in found:
                        if round(vote, 6) >= VOTE:
                            pieces += [text[end:s], MASK]
                            end = e
                    out.append("".join([*pieces, text[end:]]) if end else text)
                yield part.set_column(place, part.schema.field(place), pa.array(out, part.schema.field(place).type))

    out = cells.mapInArrow(trimmed(mask), cells.schema)
    if count_col in df.columns:
        count = df.columns.index(count_col)
        out = out.withColumn(f"c{count}", F.char_length(f"c{place}").cast(cells.schema[count].dataType))
    return out.toDF(*df.columns)
