"""Personal data and secrets: labelers propose and judge spans, expectation-maximisation weighs them, a classifier decides.

Base spans (email, ip, card, phone) follow fixed patterns and always stay. Beside them labelers propose spans of their own
(PROPOSALS), and each labeler votes yes, no or nothing on every candidate, whoever proposed it:

* regex: the strict pattern and its checks hold (base kinds), or the value has a fixed token format (secret). It proposes
  the base matches, those too that fail their check;
* gazetteer: the email's last label, the card's issuer prefix, the phone's area code, the address block or the credential's
  prefix is a known one. It proposes spelled-out emails that end in a known label, and tokens with a known prefix;
* context: words like "mail", "card" or "password" stand before it (yes), or it is glued to an identifier, a key or a
  path (no). It proposes what follows a credential's name and a sign, and numbers after words for a phone;
* shape: characters are grouped or mixed as in such data. It proposes phones without a plus and opaque runs of letters and
  digits.

Candidates are counted by kind and votes, over the whole corpus; only these counts (a few hundred at most) reach the
driver. There EM estimates how often each labeler is right, starting from what most labelers say, and a logistic
classifier is trained on the votes with EM's posteriors as soft labels. A proposal becomes a span if the classifier is at
least `threshold` sure. All work on texts is done with DataFrame functions.

Results: null text counts as empty and has no spans. Positions are code points, ends exclusive. Spans of different kinds
may overlap, those of one kind don't; an added span never overlaps a base span. Rows that repeat are kept. Without any
candidate nothing is learnt or added. A password is a secret: the kind after the listed ones.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import common

KINDS = ("email", "ip", "card", "phone", "secret")
# Possessive forms match the same texts as the plain ones here but never go back: what follows a run isn't in its class.
# A match may begin where the last one ended or where the character before can't be part of it.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be tried.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
# Gazetteers: fixed values.
TLDS = "com org net edu gov mil int info biz io de fr es uk it nl eu us ca".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|36|30[0-5])"
#: How issued credentials begin.
PREFIXES = r"(?:AKIA[0-9A-Z]{16}|gh[opsur]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,100}|xox[abprs]-[A-Za-z0-9-]{10,100}|eyJ[A-Za-z0-9_-]{10,2000}\.[A-Za-z0-9_.-]{10,2000})"
PLACEHOLDERS = r"(?i)^(?:change-?me|example\w*|your\w*|none|null|true|false|undefined|required|password|secret|token|x+|\*+)$"
CREDENTIAL = r"(?:passw(?:or)?d|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)"
WORDS = {
    "email": r"(?i)(?:e-?mail|mail|contact|correo|courriel)[^A-Za-z]{0,3}\w{0,8}[^A-Za-z]{0,3}$",
    "ip": r"(?i)(?:\bip|addr\w*|host|server)[^A-Za-z]{0,3}\w{0,8}[^A-Za-z]{0,3}$",
    "card": r"(?i)(?:card|visa|master\w*|karte|carte|tarjeta|credit)[^A-Za-z]{0,3}\w{0,8}[^A-Za-z]{0,3}$",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|telefon|\bcell)[^A-Za-z]{0,3}\w{0,8}[^A-Za-z]{0,3}$",
    "secret": rf"(?i){CREDENTIAL}[\"']?\x20?[=:]\x20?[\"']?$",
}
_DOT = r"\x20?(?:\.|\(dot\)|\[dot\]|\{dot\}|\bdot\b)\x20?"
#: What labelers propose beyond the base patterns, by kind. A kind's proposals are found in one pass and don't overlap.
PROPOSALS = {
    "email": {
        "gazetteer": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\{at\}|(?<=\x20)at(?=\x20))\x20?[A-Za-z0-9-]{1,63}(?:" + _DOT + r"[A-Za-z0-9-]{1,63}){0,6}?" + _DOT + "(?:" + "|".join(TLDS) + r")(?![A-Za-z0-9-])",
    },
    "phone": {
        "context": r"(?=[0-9(])(?<=(?:[Pp]hone|[Tt]el|[Cc]all|[Ff]ax|[Mm]obile)[:.]?\x20{0,2})[0-9(][0-9().\x20-]{7,18}[0-9](?![0-9])",
        "shape": r"(?<![0-9+.-])(?<!\+[0-9]\x20)(?<!\+[0-9][0-9]\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])",
    },
    "secret": {
        "context": rf"(?<=[=:][\"'\x20]{{0,2}})(?<=(?i:{CREDENTIAL})[\"']?\x20?[=:]\x20?[\"']?)[^\x00-\x20\"'<>,;=:]{{6,200}}+",
        "gazetteer": rf"(?<![A-Za-z0-9_-]){PREFIXES}(?![A-Za-z0-9_-])",
        "shape": r"(?<![A-Za-z0-9+/_.@-])(?=[A-Za-z+/_-]{0,200}[0-9])(?=[0-9+/_-]{0,200}[A-Za-z])[A-Za-z0-9+/_-]{16,200}+(?![A-Za-z0-9+/_@-])",
    },
}
PROPOSAL_NEEDS = {
    "email": r"[(\[{]at[)\]}]|\x20at\x20[A-Za-z0-9-]++(?:\.[A-Za-z]|\x20?[(\[{]?dot\b)",
    "phone": r"[0-9]{3}[.-][0-9]{4}|[0-9(](?<=(?:hone|el|all|ax|obile)[:.]?\x20{0,2}[0-9(])",
    "secret": rf"[0-9][+/_-]*+[A-Za-z]|[A-Za-z][+/_-]*+[0-9]|[=:](?<=(?i:{CREDENTIAL})[\"']?\x20?[=:])|AKIA|gh[opsur]_|eyJ|sk-|xox",
}
GLUED = r"(?:[A-Za-z0-9_=\"'/.+-])$"
LABELERS = ("regex", "gazetteer", "context", "shape")
CONTEXT = 32
BLOCK = 256


def running(sizes: Column) -> Column:
    """Sums of all entries before each, by blocks, so that the copying of lists stays small."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int")), lambda i: F.slice(sizes, i * BLOCK + 1, BLOCK))
    empty = F.array().cast("array<int>")

    def fold(values: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), empty.alias("out"))
        return F.aggregate(values, first, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
    return F.flatten(F.zip_with(blocks, fold(totals, F.lit(0)), fold))


def located(df: DataFrame, pattern: str, needs: str, out: str) -> DataFrame:
    """`df` with `out`: start, end, match, before, after of each match in __text, leftmost first."""
    text, p = F.col("__text"), F.lit(pattern)
    df = df.withColumn("__m", F.when(text.rlike(needs), F.regexp_extract_all(text, p, F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("__g", F.when(F.size("__m") > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>")))
    # gap 0, match 0, gap 1, ...: a match begins after all gaps up to its own and all matches before.
    steps = F.zip_with("__m", F.slice(F.col("__g"), F.lit(1), F.size("__m")), lambda m, g: F.char_length(g) + F.char_length(m))
    df = df.withColumn("__l", F.when(F.size("__m") > 0, steps)).withColumn("__s", F.when(F.size("__m") > 0, running(F.col("__l"))))

    def span(m: Column, i: Column) -> Column:
        gap, after = F.get(F.col("__g"), i), F.get(F.col("__g"), i + 1)
        start = F.get(F.col("__s"), i) + F.char_length(gap)
        before = F.substring(gap, -CONTEXT, CONTEXT)
        return F.struct(start.alias("start"), (start + F.char_length(m)).alias("end"), m.alias("match"), before.alias("before"), F.substring(after, 1, 1).alias("after"))

    return df.withColumn(out, F.transform("__m", span)).drop("__m", "__g", "__l", "__s")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(acc: Column, c: Column) -> Column:
        d = c.cast("int") * F.when(acc["i"] % 2 == 1, 2).otherwise(1)
        return F.struct((acc["i"] + 1).alias("i"), (acc["sum"] + F.when(d > 9, d - 9).otherwise(d)).alias("sum"))

    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("sum"))
    return F.aggregate(F.split(F.reverse(digits), ""), start, lambda acc, c: F.when(c == "", acc).otherwise(add(acc, c)), lambda acc: acc["sum"] % 10 == 0)


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, r"[^0-9]", "")


def valid(kind: str, match: Column) -> Column:
    n = F.char_length(digits_of(match))
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda part: part.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits_of(match))).otherwise(F.lit(False))
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def votes(kind: str, base: Column, m: Column) -> list[Column]:
    """Each labeler's vote: 1, -1 or 0."""
    text, digits = m["match"], digits_of(m["match"])
    vote = lambda yes, no=None: F.when(yes, 1).when(no if no is not None else ~yes, -1).otherwise(0)
    if kind == "secret":
        fixed = text.rlike(rf"^(?:[0-9a-f]{{16,}}|[0-9A-F]{{16,}}|{PREFIXES})$") | (text.rlike(r"^[A-Za-z0-9+/_-]{20,}={0,2}$") & text.rlike("[a-z]") & text.rlike("[A-Z]") & text.rlike("[0-9]"))
        mixed = text.rlike("[0-9]") & text.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(text, ""))) > 6)
        plain = text.rlike(r"^(?:[0-9]+|[A-Za-z]+|[^A-Za-z0-9]+)$") | text.rlike("[.](?:html?|js|py|png|jpg|pdf|com|org)$") | (F.length(F.regexp_replace(text, "[^/]", "")) > 2)
        glued = m["before"].rlike(r"(?:[/A-Za-z0-9]|(?i:href|src)=[\"']?)$")
        known = text.rlike(rf"^{PREFIXES}$")
        return [vote(fixed, ~text.rlike("[0-9]")), vote(known, text.rlike(PLACEHOLDERS)), vote(m["before"].rlike(WORDS[kind]), glued), vote(mixed & ~plain, plain)]
    last = F.lower(F.regexp_extract(text, r"([A-Za-z]+)$", 1))
    known = {
        "email": last.isin(TLDS),
        "ip": ~text.rlike(r"^(?:0|127|22[4-9]|2[3-5][0-9])\."),
        "card": digits.rlike(ISSUERS),
        "phone": digits.rlike(r"^[1-9]") & ~digits.rlike(r"^(.)\1{6}"),
    }[kind]
    shape = {
        "email": F.char_length(text) <= 80,
        "ip": ~text.rlike(r"(?:^|\.)0[0-9]"),
        "card": text.rlike(r"^(?:[0-9]{15,16}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4})$"),
        "phone": text.rlike(r"[().\x20-]"),
    }[kind]
    glued = m["before"].rlike(GLUED) | m["after"].rlike(r"^[A-Za-z0-9_]")
    return [vote(base), vote(known), vote(m["before"].rlike(WORDS[kind]), glued), vote(shape)]


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and `found`: all candidate spans with kind, base and votes."""
    df = docs.select("doc_id", F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    columns = []
    for k, kind in enumerate(KINDS):
        sources = [(kind, BASE[kind], NEEDS[kind], True)] if kind in BASE else []
        if kind in PROPOSALS:
            sources.append((f"{kind}_proposed", "|".join(PROPOSALS[kind].values()), PROPOSAL_NEEDS[kind], False))
        for name, pattern, needs, strict in sources:
            df = located(df, pattern, needs, f"__{name}")
            ok = (lambda m, kind=kind: valid(kind, m["match"])) if strict else (lambda m: F.lit(False))
            columns.append(F.transform(F.filter(f"__{name}", _plausible(kind)), _labelled(k, kind, ok)))
    return df.select("doc_id", F.concat(*columns).alias("found"))


def _plausible(kind: str):
    """Card-like: 14 to 19 digits. Most runs of digits are nothing of the kind."""
    if kind == "card":
        return lambda m: F.char_length(digits_of(m["match"])).between(14, 19)
    if kind == "phone":
        return lambda m: F.char_length(digits_of(m["match"])) >= 7
    return lambda m: F.lit(True)


def _labelled(k: int, kind: str, ok):
    def one(m: Column) -> Column:
        base = ok(m)
        return F.struct(m["start"].alias("start"), F.lit(k).alias("k"), m["end"].alias("end"), base.alias("base"), *[v.alias(x) for x, v in zip(LABELERS, votes(kind, base, m), strict=True)])

    return lambda m: one(m)


def estimate(counts: dict[tuple, int], rounds: int = 50) -> dict[tuple, float]:
    """EM over vote patterns of one kind: P(true | votes). Labelers err independently; it starts from the sum of votes.

    counts: how often each tuple of votes (1, -1, 0) occurs.
    """
    total = sum(counts.values())
    if not total:
        return {}
    n = len(next(iter(counts)))
    post = {p: min(0.95, max(0.05, 0.4 + 0.3 * sum(p))) for p in counts}
    for _ in range(rounds):
        true = sum(c * post[p] for p, c in counts.items())
        prior = (true + 1) / (total + 2)
        rates = []  # P(vote | true), P(vote | false), smoothed
        for j in range(n):
            by = {}
            for v in (1, 0, -1):
                a = sum(c * post[p] for p, c in counts.items() if p[j] == v)
                b = sum(c * (1 - post[p]) for p, c in counts.items() if p[j] == v)
                by[v] = ((a + 0.5) / (true + 1.5), (b + 0.5) / (total - true + 1.5))
            rates.append(by)
        for p in counts:
            yes, no = math.log(prior), math.log(1 - prior)
            for j in range(n):
                yes, no = yes + math.log(rates[j][p[j]][0]), no + math.log(rates[j][p[j]][1])
            post[p] = 1 / (1 + math.exp(max(-60.0, min(60.0, no - yes))))
    return post


def train(counts: dict[tuple, int], post: dict[tuple, float], steps: int = 400) -> tuple[list[float], float]:
    """A logistic classifier on all votes, fitted to soft labels by gradient steps."""
    n = len(next(iter(counts)))
    w, b, total = [0.0] * n, 0.0, sum(counts.values())
    for _ in range(steps):
        gw, gb = [0.0] * n, 0.0
        for p, c in counts.items():
            e = (1 / (1 + math.exp(-max(-30.0, min(30.0, b + sum(x * y for x, y in zip(w, p, strict=True)))))) - post[p]) * c / total
            gb += e
            gw = [g + e * y for g, y in zip(gw, p, strict=True)]
        w, b = [x - 1.0 * (g + 0.001 * x) for x, g in zip(w, gw, strict=True)], b - 1.0 * gb
    return w, b


def _code(k, *votes):
    for v in votes:
        k = k * 3 + v + 1
    return k


def annotate(docs: DataFrame, *, text: str = "text", threshold: float = 0.9) -> DataFrame:
    """doc_id and `spans`: start, k (place in KINDS), end, base; by start and kind."""
    df = common.written(candidates(docs, text), "pii-candidates")
    each = df.select(F.explode("found").alias("c")).groupBy("c.k", *[f"c.{x}" for x in LABELERS]).count()
    by_kind: dict[int, dict[tuple, int]] = {}
    for r in each.collect():  # 5 kinds and 81 patterns of votes at most
        by_kind.setdefault(r["k"], {})[tuple(r[x] for x in LABELERS)] = r["count"]
    accepted = [-1]
    for k, counts in by_kind.items():
        w, b = train(counts, estimate(counts))
        for seen in itertools.product((-1, 0, 1), repeat=len(LABELERS)):
            z = b + sum(x * y for x, y in zip(w, seen, strict=True))
            if 1 / (1 + math.exp(-z)) >= threshold and sum(seen) > 0:  # never against most of the labelers
                accepted.append(_code(k, *seen))

    base = F.filter("found", lambda c: c["base"])
    near = F.filter("found", lambda c: ~c["base"] & _code(c["k"], *[c[x] for x in LABELERS]).isin(accepted))
    df = df.select("doc_id", base.alias("sure"), near.alias("near"))
    apart = F.filter("near", lambda c: ~F.exists("sure", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])))
    whole = F.when(F.size("near") == 0, F.col("sure")).otherwise(F.concat("sure", apart))
    return df.select("doc_id", F.array_sort(F.transform(whole, lambda c: F.struct(c["start"].alias("start"), c["k"].alias("k"), c["end"].alias("end"), c["base"].alias("base")))).alias("spans"))


def as_text(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.get(kinds, c["k"]), c["start"], c["end"])), ",")


def query(spark, sf_dir: str) -> DataFrame:
    df = annotate(common.table(spark, sf_dir, "documents")).withColumn("base", F.filter("spans", lambda c: c["base"]))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return df.select("doc_id", *counts, F.sha2(as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))


def _of_kind(k: int):
    return lambda c: c["k"] == k
