"""Personal data by pattern and by boosted candidates, in Spark expressions only.

Base kinds (email, ip, card, phone) are fixed patterns with checks. On top,
generators propose spans with high recall: identifier-like tokens, digit groups,
names behind a title or label. Format and context features of each proposal go to
gradient-boosted trees, written out as CASE expressions; a proposal becomes a span
when its calibrated probability reaches the threshold. Proposals may overlap each
other and base spans.

One scan per kind cuts a text into (gap + match) strings. ``\\G`` ties each to the
end of the one before, so a text is walked once; possessive loops keep the Java
matcher off the stack. Offsets are running sums of lengths, hence code points.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What each kind matches, as Java patterns.
_RUN = r"(?:(?<![%s])|\G)"
EMAIL = _RUN % r"A-Za-z0-9._%+\-" + r"[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++"
IP = _RUN % "0-9" + r"[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20\-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9\-]+[0-9]"
SECRET_WORD = r"(?i:token|secret|passw(?:or)?d|passphrase|api[_\x20\-]?key|auth|credentials?)[\"']?\x20{0,2}[=:]\x20{0,2}[\"']?"
TOKEN = rf"(?:(?<=[=:\x20\"'])(?<=[=:]\x20{{0,2}}[\"']?)(?<={SECRET_WORD})[^\s\"'<>,;=:]{{4,}}+|" + _RUN % r"A-Za-z0-9_\-" + r"(?=[A-Za-z_\-]*+[0-9])[A-Za-z0-9_\-]{12,}+)"
# a number shape ends before a space or mark; the long run stops at its last whole digit group and before a shape
_SHAPE = r"(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|(?:\([0-9]{3}\)\x20?|[0-9]{3}[\-.\x20])[0-9]{3}[\-.][0-9]{4})(?![A-Za-z0-9_]|[.\-/][0-9])"
_GROUP = r"[0-9]++(?![A-Za-z_])"
NUMBER = rf"(?<![A-Za-z0-9_])(?:(?<![0-9][.\-/]){_SHAPE}|(?=\(?[0-9](?:(?!\x20{_SHAPE})[\x20().\-/]{{0,3}}+[0-9]){{6}})\(?{_GROUP}(?:(?!\x20{_SHAPE})[\x20().\-/]{{1,3}}+{_GROUP})*+)"
NAME = r"(?:Mr|Mrs|Ms|Dr|Prof|Name|Contact|Patient)[.:]{1}+\x20\p{Lu}\p{Ll}++(?:\x20\p{Lu}\p{Ll}++){0,2}+"
OCTETS = r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
CONTEXT = 24


def running_sums(lengths: Column, block: int = 64) -> Column:
    """Inclusive running sums of an array column, in blocks so that no step copies the whole array for each element."""
    add = lambda a, x: a + x
    zero = F.lit(0)
    sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / block).cast("int")), lambda b: F.aggregate(F.slice(lengths, b * block + 1, block), zero, add))
    before = F.aggregate(sums, F.array(zero), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s)))
    each = lambda base, b: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(block), F.size(lengths) - b * block)), lambda k: base + F.aggregate(F.slice(lengths, b * block + 1, k), zero, add)
    )
    out = F.flatten(F.transform(before, lambda base, b: F.when(b * block < F.size(lengths), each(base, b)).otherwise(F.array().cast("array<int>"))))
    return F.when(F.size(lengths) > 0, out).otherwise(F.array().cast("array<int>"))


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    maybe: Callable[[Column], Column]
    valid: Callable[[Column], Column]


_digits = lambda v: F.regexp_replace(v, "[^0-9]", "")
_has_digit = lambda t: t.rlike("[0-9]")
BASE = (
    Kind("email", EMAIL, lambda t: t.contains("@"), lambda v: F.lit(True)),
    Kind("ip", IP, lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda v: v.rlike(OCTETS)),
    Kind("card", CARD, lambda t: t.rlike(r"[0-9](?:[\x20\-]?[0-9]){11}"), lambda v: F.length(_digits(v)).between(12, 19) & F.call_function("luhn_check", _digits(v))),
    Kind("phone", PHONE, lambda t: t.contains("+"), lambda v: F.length(_digits(v)).between(9, 15)),
)
PROPOSED = (
    Kind("secret", TOKEN, lambda t: _has_digit(t) | t.rlike(SECRET_WORD), lambda v: F.lit(True)),
    Kind("number", NUMBER, _has_digit, lambda v: F.length(_digits(v)) >= 7),
    Kind("name", NAME, lambda t: t.rlike(r"(?:Mr|Mrs|Ms|Dr|Prof|Name|Contact|Patient)[.:] "), lambda v: F.lit(True)),
)
RANK = {k.name: i for i, k in enumerate(BASE + PROPOSED)}


def _cut(text: Column, kind: Kind, group: int) -> Column:
    pattern = rf"\G([\s\S]*?)({kind.pattern})"
    return F.when(kind.maybe(text), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(F.array().cast("array<string>"))


# ---- features of a proposal -------------------------------------------------

FEATURES = ("generator", "length", "digits", "upper", "marks", "distinct", "secret_word", "phone_word", "id_word", "luhn", "hex", "ssn_shape", "phone_shape", "assigned", "turns", "date_shape")


def _features(kind: str, v: Column, left: Column) -> dict[str, Column]:
    n = F.greatest(F.length(v), F.lit(1))
    count = lambda p: F.length(F.regexp_replace(v, p, ""))  # noqa: E731  characters outside the class p
    low = F.lower(left)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return {
        "generator": F.lit(float(RANK[kind])),
        "length": F.length(v).cast("double"),
        "digits": count("[^0-9]") / n,
        "upper": count("[^A-Z]") / n,
        "marks": count("[A-Za-z0-9]").cast("double"),
        "distinct": F.size(F.array_distinct(F.split(F.lower(v), ""))) / n,
        "secret_word": flag(low.rlike("token|secret|passw|api.?key|auth|bearer|credential")),
        "phone_word": flag(low.rlike("phone|tel[.: ]|call|mobile|fax|cell|whatsapp")),
        "id_word": flag(low.rlike("ssn|social sec|passport|account|iban|driver|national id|tax id|card|patient|mrn")),
        "luhn": flag(F.call_function("luhn_check", _digits(v)) & (F.length(_digits(v)) >= 12)),
        "hex": flag(F.lower(v).rlike("^[0-9a-f]+$")),
        "ssn_shape": flag(v.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")),
        "phone_shape": flag(v.rlike(r"^\(?[0-9]{3}\)?[-. ]?[0-9]{3}[-. ][0-9]{4}$")),
        "assigned": flag(left.rlike("[=:][ \"']*$")),
        "turns": F.length(F.regexp_replace(F.regexp_replace(v, "[0-9]+", "0"), "[^0]+", "")).cast("double"),
        "date_shape": flag(v.rlike(r"^(?:19|20)[0-9]{2}[-/. ]|^[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)?[0-9]{2}")),
    }


# ---- training on made-up examples ------------------------------------------


def formats(r: random.Random) -> list[tuple[Callable[[], str], int]]:
    """Ways in which a proposal stands in a text, and whether it is private there. All values are invented."""
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    drawn = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    hexes, capitals, letters = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    token = lambda: drawn(r.choice([hexes, letters]), r.randint(20, 44))
    word = lambda: drawn("aeionrstlmdu", r.randint(2, 9))
    key = lambda: r.choice(["token", "secret", "api_key", "api-key", "password", "passwd", "auth", "credential", "client_secret"])
    phone = lambda: r.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {}-{}"]).format(digits(3), digits(3), digits(4))
    day = lambda: (r.randint(1900, 2035), r.randint(1, 12), r.randint(1, 28))
    date = lambda: (lambda y, m, d: r.choice([f"{y}-{m:02d}-{d:02d}", f"{d:02d}.{m:02d}.{y}", f"{m}/{d}/{y}", f"{y}{m:02d}{d:02d}", f"{y}-{m:02d}-{d:02d} {r.randint(10, 23)}:{digits(2)}"]))(*day())
    return [
        (lambda: f'{key()} {r.choice("=:")} "{r.choice([token, lambda: drawn(hexes, r.choice([24, 32, 40, 64]))])()}"', 1),
        (lambda: f"{key()}{r.choice(['=', ': ', ' = '])}{drawn(letters + '!?$%', r.randint(6, 14))}", 1),
        (lambda: f"{r.choice(['Bearer', 'credential', 'authorization: token'])} {token()}", 1),
        (lambda: f"{r.choice(['AKIA', 'ASIA', 'ghp_', 'xoxb-', 'sk_live_'])}{drawn(r.choice([capitals, letters]), r.randint(16, 36))}", 1),
        (lambda: f"{r.choice(['phone', 'call', 'Tel.', 'mobile', 'fax', 'cell', 'whatsapp'])} {phone()}", 1),
        (lambda: f"{word()} +{r.choice(['1', '44', '49'])} {phone()}", 1),
        (lambda: f"{r.choice(['SSN', 'social security', 'ssn:', 'tax id'])} {digits(3)}-{digits(2)}-{digits(4)}", 1),
        (lambda: f"{word()} {digits(3)}-{digits(2)}-{digits(4)}", 1),
        (lambda: f"{r.choice(['passport', 'account', 'national id', 'tax id', 'patient', 'mrn'])} {r.choice(['', 'no. ', '# ', ': '])}{digits(r.randint(8, 12))}", 1),
        (lambda: f"{r.choice(['IBAN', 'account', 'iban:'])} {r.choice(['DE', 'GB', 'FR'])}{digits(20)}", 1),
        (lambda: f"{r.choice(['Mr.', 'Mrs.', 'Dr.', 'Name:', 'Patient:', 'Contact:'])} {word().title()} {word().title()}", 1),
        (lambda: f"{word()} {digits(r.choice([13, 14, 16, 19]))}", 0),
        (lambda: f"{word()} {digits(r.randint(7, 11))}", 0),
        (lambda: f"{r.choice(['order', 'invoice', 'page', 'build', 'ticket', word()])} {digits(r.randint(7, 10))}", 0),
        (lambda: f"{word()} {date()}", 0),
        (lambda: f"{word()} {r.randint(1900, 1999)} - {r.randint(2000, 2035)}", 0),
        (lambda: f"{word()} {digits(3)}.{digits(2)}.{digits(3)}.{digits(2)}", 0),
        (lambda: f"{word()} {digits(2)}.{digits(4)} {digits(2)}.{digits(4)}", 0),
        (lambda: f"{word()} {digits(1)} {digits(3)} {digits(3)} {digits(3)}", 0),
        (lambda: f"{word()} {word()}{word()}{digits(1)}{word()}{word()}", 0),
        (lambda: f"{word()} {'-'.join(word() for _ in range(4))}-{digits(2)}", 0),
        (lambda: f"{word()} {'_'.join([r.choice(['img', 'file', 'scan', word()]), digits(8), digits(6)])}", 0),
        (lambda: f"{r.choice(['sha', 'commit', 'etag', 'checksum', 'md5', word()])} {drawn(hexes, r.choice([32, 40, 64]))}", 0),
        (lambda: f"{word()} {'-'.join(drawn(hexes, k) for k in (8, 4, 4, 4, 12))}", 0),
        (lambda: f"{word()} ISBN {digits(3)}-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", 0),
        (lambda: f"{word()} v{digits(1)}-{digits(2)}-{word()}-{digits(4)}-{word()}", 0),
    ]


def examples(n: int = 2600, seed: int = 11) -> list[tuple[str, int]]:
    """Texts with one proposal each in turn of ``formats``, between other words, and whether it is private."""
    r = random.Random(seed)
    made = formats(r)
    word = lambda: "".join(r.choice("aeionrstlmdu") for _ in range(r.randint(2, 9)))
    return [(f"{word()} {word()}, {made[i % len(made)][0]()} {word()} {word()}.", made[i % len(made)][1]) for i in range(n)]


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, l2: float = 1.0):
    """A regression tree on gradients: a leaf value, or (feature, cut, left, right)."""
    leaf = float(g.sum() / (h.sum() + l2))
    if depth == 0:
        return leaf
    best, base = (1e-6, None, None), g.sum() ** 2 / (h.sum() + l2)
    for j in range(x.shape[1]):
        for cut in np.unique(np.quantile(x[:, j], np.linspace(0.05, 0.95, 12))):
            a = x[:, j] < cut
            if a.any() and not a.all():
                gain = g[a].sum() ** 2 / (h[a].sum() + l2) + g[~a].sum() ** 2 / (h[~a].sum() + l2) - base
                if gain > best[0]:
                    best = (gain, j, float(cut))
    if best[1] is None:
        return leaf
    a = x[:, best[1]] < best[2]
    return best[1], best[2], _grow(x[a], g[a], h[a], depth - 1, l2), _grow(x[~a], g[~a], h[~a], depth - 1, l2)


def _value(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    j, cut, a, b = tree
    return np.where(x[:, j] < cut, _value(a, x), _value(b, x))


@dataclass(frozen=True)
class Boosted:
    trees: tuple
    slope: float
    offset: float
    threshold: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return sum((_value(t, x) for t in self.trees), np.zeros(len(x)))

    def column(self, f: dict[str, Column]) -> Column:
        """Calibrated probability as an expression."""

        def case(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            j, cut, a, b = tree
            return F.when(f[FEATURES[j]] < cut, case(a)).otherwise(case(b))

        total = F.lit(0.0)
        for t in self.trees:
            total = total + case(t)
        return 1 / (1 + F.exp(-(total * self.slope + self.offset)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 18, depth: int = 3, rate: float = 0.4, precision: float = 0.98) -> Boosted:
    """Trees on three quarters of the rows; on the rest the logit is calibrated
    (a logistic fit) and the lowest threshold with that precision is taken."""
    held = np.arange(len(x)) % 4 == 3
    f, trees = np.zeros(len(x)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        shrink = lambda t: t * rate if isinstance(t, float) else (t[0], t[1], shrink(t[2]), shrink(t[3]))
        tree = shrink(_grow(x[~held], (y - p)[~held], np.maximum(p * (1 - p), 1e-6)[~held], depth))
        trees.append(tree)
        f += _value(tree, x)
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-(a * f[held] + b)))
        a -= 0.05 * ((p - y[held]) * f[held]).mean() + 0.001 * (a - 1)
        b -= 0.05 * (p - y[held]).mean()
    p = 1 / (1 + np.exp(-(a * f[held] + b)))
    good = [t for t in np.linspace(0.5, 0.99, 50) if (p >= t).any() and y[held][p >= t].mean() >= precision]
    return Boosted(tuple(trees), float(a), float(b), float(good[0] if good else 0.99))


def featured(rows: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all proposals in labelled texts, and their labels: a few thousand rows."""
    spark = SparkSession.getActiveSession()
    cut = _scanned(spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(rows)], "doc_id long, text string, y int"), PROPOSED)
    found = cut.select("y", F.explode(F.concat(*[_proposals(k) for k in PROPOSED])).alias("p"))
    got = found.select("y", *[F.col("p.f")[n].alias(n) for n in FEATURES]).collect()
    return np.array([[r[n] for n in FEATURES] for r in got], float).reshape(-1, len(FEATURES)), np.array([r["y"] for r in got], float)


@lru_cache(maxsize=4)
def trained(app: str) -> Boosted:
    x, y = featured(examples())
    order = np.lexsort(np.c_[y, x].T)
    order = order[np.argsort(np.arange(len(order)) * 7919 % len(order), kind="stable")]
    return boost(x[order], y[order])


# ---- spans ------------------------------------------------------------------


def _scanned(docs: DataFrame, kinds: tuple[Kind, ...]) -> DataFrame:
    """Adds x_KIND (gap and match), v_KIND (match) and e_KIND (ends) arrays.

    Each step is a projection of its own and uses the last one's columns more
    than once, so the optimizer keeps them apart and no pattern runs twice.
    """
    text = F.coalesce("text", F.lit(""))
    out = docs.withColumns({f"x_{k.name}": _cut(text, k, 0) for k in kinds})
    none = F.array().cast("array<string>")
    out = out.withColumns({f"v_{k.name}": F.when(F.size(f"x_{k.name}") > 0, _cut(text, k, 2)).otherwise(none) for k in kinds})
    out = out.withColumns({f"n_{k.name}_": F.transform(f"x_{k.name}", lambda s: F.length(s)) for k in kinds})
    return out.withColumns({f"e_{k.name}": running_sums(F.col(f"n_{k.name}_")) for k in kinds})


def _base_spans(k: Kind) -> Column:
    spans = F.zip_with(f"e_{k.name}", f"v_{k.name}", lambda e, v: F.struct((e - F.length(v)).alias("start"), F.lit(RANK[k.name]).alias("rank"), e.alias("end"), F.lit(k.name).alias("kind"), k.valid(v).alias("ok")))
    return F.filter(spans, lambda s: s["ok"])


def _proposals(k: Kind) -> Column:
    rows = F.arrays_zip(*[F.col(f"{c}_{k.name}").alias(c) for c in "evx"])

    def one(r: Column) -> Column:
        gap = F.length(r["x"]) - F.length(r["v"])
        left = F.substring(r["x"], F.greatest(gap - CONTEXT + 1, F.lit(1)), F.least(gap, F.lit(CONTEXT)))
        f = _features(k.name, r["v"], left)
        return F.struct((r["e"] - F.length(r["v"])).alias("start"), F.lit(RANK[k.name]).alias("rank"), r["e"].alias("end"), F.lit(k.name).alias("kind"), F.struct(*[c.alias(n) for n, c in f.items()]).alias("f"))

    return F.transform(F.filter(rows, lambda r: k.valid(r["v"])), one)


def _added(k: Kind, model: Boosted) -> Column:
    """Proposals the model accepts."""
    scored = F.transform(
        f"p_{k.name}", lambda p: F.struct(p["start"].alias("start"), p["rank"].alias("rank"), p["end"].alias("end"), p["kind"].alias("kind"), (model.column({n: p["f"][n] for n in FEATURES}) >= model.threshold).alias("ok"))
    )
    return F.filter(scored, lambda s: s["ok"])


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def find_private(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """doc_id, counts of base kinds, base_sha256 and spans, one row per row of docs.

    Null and empty texts have no spans. Rows are independent: repeated rows,
    null ids and other columns change nothing.
    """
    model = model or trained(docs.sparkSession.sparkContext.applicationId)
    kinds = BASE + PROPOSED
    cut = _scanned(docs.select("doc_id", "text"), kinds)
    cut = cut.select("doc_id", *[_base_spans(k).alias(f"b_{k.name}") for k in BASE], *[_proposals(k).alias(f"p_{k.name}") for k in PROPOSED])
    cut = cut.withColumn("base", F.array_sort(F.concat(*[F.col(f"b_{k.name}") for k in BASE])))
    cut = cut.withColumn("added", F.when(F.size(F.col("p_secret")) + F.size("p_number") + F.size("p_name") > 0, F.concat(*[_added(k, model) for k in PROPOSED])))
    spans = F.when(F.size("added") > 0, F.array_sort(F.concat("base", "added"))).otherwise(F.col("base"))
    return cut.select(
        "doc_id",
        *[F.size(f"b_{k.name}").cast("long").alias(f"n_{k.name}") for k in BASE],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(spans).alias("spans"),
    )


def _total(pieces: str) -> Column:
    return F.aggregate(pieces, F.lit(0), lambda a, s: a + F.length(s))


def _rewriter(k: Kind, model: Boosted) -> Callable[[Column, Column], Column]:
    def rewrite(s: Column, m: Column) -> Column:
        gap = F.length(s) - F.length(m)
        ok = k.valid(m)
        if k in PROPOSED:
            left = F.substring(s, F.greatest(gap - CONTEXT + 1, F.lit(1)), F.least(gap, F.lit(CONTEXT)))
            ok = ok & (model.column(_features(k.name, m, left)) >= model.threshold)
        return F.when(ok, F.concat(F.substring(s, F.lit(1), gap), F.lit(f"[{k.name.upper()}]"))).otherwise(s)

    return rewrite


def redact(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """docs with private spans of ``text`` replaced by [KIND], all columns kept, whatever their names.

    Kinds go one after another, in the order listed, each over what the ones
    before left, so overlaps are covered and the work stays linear in the text.
    A null text stays null; repeated rows are treated alike; an empty table stays empty.
    """
    model = model or trained(docs.sparkSession.sparkContext.applicationId)
    out = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("text").alias("t"))
    for k in (BASE[0], BASE[3], BASE[2], BASE[1], *PROPOSED):
        none = F.array().cast("array<string>")
        out = out.withColumn("x", _cut(F.coalesce("t", F.lit("")), k, 0))
        out = out.withColumn("v", F.when(F.size("x") > 0, _cut(F.col("t"), k, 2)).otherwise(none))
        whole = F.concat(F.array_join(F.zip_with("x", "v", _rewriter(k, model)), ""), F.substring(F.col("t"), _total("x") + 1, F.length("t")))
        out = out.withColumn("t", F.when(F.size("x") > 0, whole).otherwise(F.col("t"))).drop("x", "v")
    return out.select(*[F.col("t").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
