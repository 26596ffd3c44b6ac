"""Operator 1, secret scans by a character convolutional network.

Candidates are all runs of LONG or more key characters of whatever kind, those of WIDE
or more with a digit in them or of mixed case, and all values that follow a name like
token or password.  Each is seen with LEFT characters before and RIGHT after it; a
longer candidate than BODY characters is seen in overlapping pieces, and the highest
chance counts.  The network (embedding, convolution of width KERNEL, maximum over
places, logistic output) is trained in numpy on labelled findings and its output
calibrated on held-out ones by Platt scaling.  For each class of candidate the
threshold is the greatest at which RECALL of the held-out secrets of the class are
found.

No table holds labels of secrets, so the labelled findings are made by findings():
formats of public documentation of keys and tokens, as prose, code and settings name
them, against what looks alike: digests, commit and trace ids, UUIDs, card and telephone
numbers, file names, long words, addresses and placeholders.  They are set in passages of
the table's own documents, of which contexts() takes at most CONTEXTS, the first by
hash, so that training, calibration and thresholds see what the scan will see.

Defined cases: null and empty texts have no candidates; texts are scanned whole,
however long; overlapping candidates are merged into the longer; repeated rows and
equal findings (ties) each come back; row_key tells rows of one doc_id apart; an empty
table gives no rows, its network is trained without passages; other columns are not looked
at.  Secrets are not put out: a finding has its place, length, hash and first characters.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEFT, BODY, RIGHT = 24, 64, 8
WIDE, LONG = 12, 16
KERNEL, EMBED, FILTERS = 5, 8, 32
#: Of the held-out secrets of a class; 0.98 is wanted of secrets elsewhere.
RECALL = 0.99
TRAINING = 12_000
EPOCHS = 8
CONTEXTS = 500
CLASSES = ("assigned", "bare")
_SPAN = LEFT + BODY + RIGHT
_RUN = re.compile(r"[A-Za-z0-9+/=_\-]{%d,}" % WIDE)
_NAMED = re.compile(r"(?i)(?:pass(?:word|wd|phrase)?|secret|token|api[_-]?key|apikey|auth|credentials?|private[_-]?key|access[_-]?key)[\"']?\s{0,3}(?:=|:|=>)\s{0,3}[\"']?([^\s\"',;]{6,})")
_KEYLIKE = re.compile(r"\d|[a-z][A-Z]")
_OUT = "doc_id long, row_key long, begin long, until long, kind string, shown string, sha256 string, chance double, secret boolean"


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(from, to, class) in order, none overlapping."""
    found = [(m.start(1), m.end(1), "assigned") for m in _NAMED.finditer(text)]
    for m in _RUN.finditer(text):
        x = m.group()
        if len(x) >= LONG or _KEYLIKE.search(x):
            found.append((m.start(), m.end(), "bare"))
    out: list[tuple[int, int, str]] = []
    for a, z, kind in sorted(found):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]), min(kind, out[-1][2]))
        else:
            out.append((a, z, kind))
    return out


def views(text: str, a: int, z: int) -> list[bytes]:
    """The candidate's pieces with their surroundings, a byte a character, padded."""
    out = []
    for at in range(a, z, BODY // 2):
        end = min(z, at + BODY)
        left, body, right = text[max(0, at - LEFT) : at], text[at:end], text[end : end + RIGHT]
        seen = left.rjust(LEFT, "\x00") + body.ljust(BODY, "\x00") + right.ljust(RIGHT, "\x00")
        out.append(seen.encode("latin-1", "replace"))
        if end == z:
            break
    return out


def _codes(seen: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(seen), np.uint8).reshape(-1, _SPAN)
    return np.where(x >= 128, 96, np.where(x == 0, 97, np.where(x < 32, 95, x.astype(np.int64) - 32)))


_WHERE = np.zeros((_SPAN, 2), np.float32)
_WHERE[LEFT : LEFT + BODY, 0] = 1
_WHERE[:LEFT, 1] = 1


@dataclass
class Network:
    embed: np.ndarray
    kernel: np.ndarray
    kernel_bias: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    scale: float = 1.0
    shift: float = 0.0
    thresholds: tuple[float, ...] = (0.5, 0.5)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.kernel, self.kernel_bias, self.out, self.bias]

    def forward(self, codes: np.ndarray):
        x = np.concatenate([self.embed[codes], np.broadcast_to(_WHERE, (len(codes), _SPAN, 2))], axis=2)
        places = _SPAN - KERNEL + 1
        rows = np.lib.stride_tricks.sliding_window_view(x, KERNEL, axis=1).transpose(0, 1, 3, 2).reshape(len(codes) * places, -1)
        h = (rows @ self.kernel + self.kernel_bias).reshape(len(codes), places, -1)
        # one maximum before the candidate's start, one from there on
        parts = [h[:, : LEFT - KERNEL + 1], h[:, LEFT - KERNEL + 1 :]]
        tops = [p.argmax(axis=1) for p in parts]
        tops[1] = tops[1] + LEFT - KERNEL + 1
        at = np.concatenate(tops, axis=1)
        n = np.arange(len(codes))[:, None]
        f = np.tile(np.arange(FILTERS), 2)
        best = np.maximum(h[n, at, f], 0)
        return best @ self.out + self.bias[0], rows, at, best

    def logits(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.float32), *(self.forward(codes[i : i + 256])[0] for i in range(0, len(codes), 256))])

    def chances(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.logits(codes) + self.shift)))


def _train(codes: np.ndarray, y: np.ndarray, seed: int = 1) -> Network:
    rng = np.random.default_rng(seed)
    width = KERNEL * (EMBED + 2)
    net = Network(*(rng.normal(0, s, n).astype(np.float32) for s, n in ((0.3, (98, EMBED)), (width**-0.5, (width, FILTERS)), (0.0, FILTERS), (0.2, 2 * FILTERS), (0.0, 1))))
    p = net.parameters()
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    step, places = 0, _SPAN - KERNEL + 1
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for i in range(0, len(y), 64):
            some = order[i : i + 64]
            c = codes[some]
            logit, rows, at, best = net.forward(c)
            d = ((1 / (1 + np.exp(-logit)) - y[some]) / len(some)).astype(np.float32)
            through = d[:, None] * net.out * (best > 0)
            where = (np.arange(len(c))[:, None] * places + at).ravel()
            filt = np.tile(np.arange(FILTERS), 2 * len(c))
            seen = rows[where]
            gk = np.zeros_like(net.kernel.T)
            np.add.at(gk, filt, seen * through.ravel()[:, None])
            gb = np.bincount(filt, weights=through.ravel(), minlength=FILTERS).astype(np.float32)
            back = (net.kernel.T[filt] * through.ravel()[:, None]).reshape(-1, KERNEL, EMBED + 2)[:, :, :EMBED]
            spots = at.ravel()[:, None] + np.arange(KERNEL)
            ge = np.zeros_like(net.embed)
            np.add.at(ge, c[np.repeat(np.arange(len(c)), 2 * FILTERS)[:, None], spots].ravel(), back.reshape(-1, EMBED))
            step += 1
            rate = 0.004 * (1 - epoch / EPOCHS) + 0.0004
            for k, g in enumerate((ge, gk.T, gb, best.T @ d, d.sum(keepdims=True))):
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)
    return net


def _platt(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b = 1.0, 0.0
    for _ in range(200):
        q = 1 / (1 + np.exp(-(a * logit + b)))
        r, w = q - y, np.maximum(q * (1 - q), 1e-6)
        h = np.array([[(w * logit * logit).sum() + 1e-3, (w * logit).sum()], [(w * logit).sum(), w.sum() + 1e-3]])
        da, db = np.linalg.solve(h, [(r * logit).sum() + 1e-3 * (a - 1), r.sum()])
        a, b = a - 0.5 * da, b - 0.5 * db
    return float(a), float(b)


def contexts(docs: DataFrame, bound: int = CONTEXTS) -> list[str]:
    """Texts of at most bound documents, the first by hash."""
    some = docs.where("text IS NOT NULL").select("doc_id", "text")
    return [r["text"] for r in common.first_by_hash(some, bound, "doc_id", "text").collect()]


def findings(n: int, seed: int, passages: list[str] | None = None) -> list[tuple[str, int, int, str, int]]:
    """Labelled findings: text, from, to, class, 1 for a secret; half of them in passages, if any are given."""
    rng = np.random.default_rng(seed)
    pick = lambda s: s[int(rng.integers(len(s)))]
    draw = lambda alphabet, k: "".join(pick(alphabet) for _ in range(k))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alnum, b64, hexa = low + up + dig, low + up + dig + "+/", "0123456789abcdef"
    syllables = [draw(low, int(rng.integers(1, 4))) + pick("aeiou") + draw(low, int(rng.integers(0, 3))) for _ in range(150)] + ["é", "ñ", "ung", "tion", "ä"]
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 4))))
    prose = lambda k: " ".join(word() for _ in range(k))
    long_word = lambda: "".join(pick(syllables) for _ in range(12))[: int(rng.integers(16, 30))]
    names = ["token", "api_key", "apikey", "secret", "password", "passwd", "auth", "credential", "access_key", "private_key", "client_secret", "auth_token", "db_password"]

    def case(x: str) -> str:
        return x.upper() if rng.random() < 0.25 else x

    def secret() -> str:
        return pick([
            lambda: draw(hexa, pick([32, 40, 40, 64])), lambda: draw(alnum, int(rng.integers(20, 50))), lambda: "AKIA" + draw(up + dig, 16),
            lambda: "ghp_" + draw(alnum, 36), lambda: "sk_live_" + draw(alnum, 24), lambda: "xoxb-" + draw(dig, 11) + "-" + draw(alnum, 24),
            lambda: "eyJ" + draw(alnum, 20) + "_" + draw(alnum, 40), lambda: draw(b64, 40) + pick(["", "=", "=="]), lambda: "AIza" + draw(alnum + "_-", 35), lambda: "glpat-" + draw(alnum, 20),
            lambda: "npm_" + draw(alnum, 36), lambda: draw(low, int(rng.integers(20, 40))),
        ])()

    def assigned(value: str) -> tuple[str, str]:
        name = case(pick(names))
        a, z = pick([(' = "', '"'), ("='", "'"), (": ", ""), ('": "', '"'), (" = ", ""), ("=", ""), (": '", "'")])
        return name + a, z

    out = []
    while len(out) < n:
        y = int(rng.random() < 0.5)
        if y:
            if rng.random() < 0.7:
                value = secret() if rng.random() < 0.8 else draw(alnum + "!@#$%^&*", int(rng.integers(8, 20)))
                value = case(value) if re.fullmatch("[0-9a-f]+", value) else value
                before, after = assigned(value)
            else:
                value = pick([lambda: "AKIA" + draw(up + dig, 16), lambda: "ghp_" + draw(alnum, 36), lambda: "sk_live_" + draw(alnum, 24), lambda: "xoxb-" + draw(dig, 11) + "-" + draw(alnum, 24), lambda: "AIza" + draw(alnum + "_-", 35), lambda: "glpat-" + draw(alnum, 20), lambda: "eyJ" + draw(alnum, 20) + "_" + draw(alnum, 40), lambda: "ghs_" + draw(alnum, 36), lambda: "npm_" + draw(alnum, 36)])()
                before, after = pick(["", "Bearer ", "key ", "export X=", '"']), pick(["", '"', " "])
        elif rng.random() < 0.3:
            value = pick([lambda: "your_" + word() + "_here", lambda: "x" * int(rng.integers(6, 20)), lambda: "changeme" + draw(dig, 2), lambda: "${" + word().upper() + "_KEY}", lambda: "<" + word() + "-token>", lambda: "os.environ[" + word(), lambda: "example" + draw(dig, 3), lambda: word() + word() + word(), lambda: "REDACTED" + draw("*", 4), lambda: "getToken(" + word() + ")"])()
            before, after = assigned(value)
        else:
            value, before = pick([
                lambda: (draw(dig, pick([13, 14, 15, 16, 16, 16, 18])), pick(["", "no. ", "card ", "id "])), lambda: (draw(hexa, 40), pick(["commit ", "Merge ", "rev ", "parent "])),
                lambda: (draw(hexa, 64), pick(["sha256:", "sha256=", "digest: ", "checksum "])), lambda: (draw(hexa, 32), pick(["md5 ", "etag ", "trace_id=", "md5:"])),
                lambda: ("-".join(draw(hexa, k) for k in (8, 4, 4, 4, 12)), pick(["", "uuid ", "id=", "request "])), lambda: (draw(dig, 4) + "-" + draw(dig, 2) + "-" + draw(dig, 2) + "T" + draw(dig, 2), ""),
                lambda: (word() + "/" + word() + "/" + word() + draw(dig, 3), pick(["/", "in ", "./"])), lambda: (word() + "-" + word() + "-" + draw(dig, 4), pick(["", "https://" + word() + ".com/"])),
                lambda: ("_".join([word(), word(), word(), draw(dig, 2)]), ""), lambda: (word().upper() + "-" + draw(dig, 12), "order "), lambda: ("".join(word().title() for _ in range(5)), "class "),
                lambda: ("=" * int(rng.integers(8, 30)) + draw(dig, 2) + "-" * 8, ""), lambda: (word() + word() + word() + draw(dig, 2), ""), lambda: (long_word(), ""), lambda: (case(long_word()).capitalize() if rng.random() < 0.5 else long_word().upper(), ""), lambda: ("555-" + draw(dig, 4) + "-" + draw(dig, 8), "+1 "),
            ])()
            after = ""
        head, tail = prose(int(rng.integers(0, 8))), prose(int(rng.integers(0, 5)))
        if passages and rng.random() < 0.5:
            p = pick(passages)
            i = int(rng.integers(len(p) + 1))
            head, tail = p[max(0, i - 60) : i], p[i : i + 40]
        head += pick([" ", " ", "\n", " | ", "!! ", ""])
        text = head + before + value + after + pick([" ", " ", "\n", ".", " | ", ", "]) + tail
        at = len(head) + len(before)
        for a, z, kind in candidates(text):
            if a < at + len(value) and z > at:
                out.append((text, a, z, kind, y))
                break
    return out


def fitted(training: int = TRAINING, passages: list[str] | None = None) -> Network:
    """A third more findings calibrate the network and set its thresholds."""
    known = findings(training, 11, passages)
    net = _train(_codes([views(t, a, z)[0] for t, a, z, _, _ in known]), np.array([y for *_, y in known], np.float32))
    other = findings(training // 3, 12, passages)
    logit = np.array([net.logits(_codes(views(t, a, z))).max() for t, a, z, _, _ in other])
    y = np.array([x[4] for x in other])
    net.scale, net.shift = _platt(logit, y)
    chance = 1 / (1 + np.exp(-(net.scale * logit + net.shift)))
    limits = []
    for c in CLASSES:
        own = np.sort(chance[(y == 1) & np.array([x[3] == c for x in other])])
        limits.append(float(own[int((1 - RECALL) * len(own))]) if len(own) else 0.5)
    net.thresholds = tuple(limits)
    return net


@cache
def model(training: int = TRAINING) -> Network:
    """Trained once a process, without passages."""
    return fitted(training)


def scan(docs: DataFrame, net: Network) -> DataFrame:
    """Every candidate of every row, with its calibrated chance and whether that reaches the threshold of its class."""
    known = docs.sparkSession.sparkContext.broadcast(net)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = known.value
        for b in batches:
            ids, keys, rows, seen, owner = b["doc_id"].to_pylist(), b["row_key"].to_pylist(), [], [], []
            for d, text in enumerate(b["text"].to_pylist()):
                for a, z, kind in candidates(text or ""):
                    v = views(text, a, z)
                    owner += [len(rows)] * len(v)
                    seen += v
                    rows.append((ids[d], keys[d], a, z, kind, text[a : a + 4], hashlib.sha256(text[a:z].encode("utf-8", "replace")).hexdigest()))
            chance = np.zeros(len(rows))
            if seen:
                np.maximum.at(chance, owner, net.chances(_codes(seen)))
            limit = np.array([net.thresholds[CLASSES.index(r[4])] for r in rows])
            kinds = [pa.int64()] * 4 + [pa.string()] * 3
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(chance, pa.float64()), pa.array(chance >= limit, pa.bool_())], names=[c.split()[0] for c in _OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), common.row_key().alias("row_key"), "text").mapInArrow(look, _OUT)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return scan(docs, fitted(passages=contexts(docs)))
