"""Personal data by weak supervision: regex, gazetteer and context labelers vote on candidate spans.

Candidates are the matches of the base kinds, base matches that fail their check by a little (kinds ending in _like), and
those of some more kinds. Expectation-maximisation over the counts of vote patterns (Dawid and Skene) estimates how
reliable each labeler is and how likely each pattern is personal data. A logistic span classifier, which sees not the
votes but the span (kind, length, digits, separators, check, characters and cue words on both sides), is trained on those
likelihoods and decides: it settles what the votes leave open and overrules them where spans of the same make speak
against them. Counts cover all documents; their number is bounded by the number of patterns, so the driver fits both
models on them. Spans of the four base kinds are kept whatever the classifier says. Only DataFrame functions run on the
executors.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, let, table

# Kinds in the order in which they are listed and their patterns. Quantifiers are possessive and starts
# are anchored only where that cannot change a match; both keep the scan linear on long runs of one character class.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MORE = {
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+)(.\x20-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "person": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z][a-z]+(?:\x20[A-Z][a-z]+)?",
}
PATTERNS = {**BASE, **MORE}
#: Kinds in the order of their ranks; those in LIKE are matches of a base kind that fail its check.
LIKE = {"ip_like": "ip", "card_like": "card", "phone_like": "phone"}
KINDS = [*BASE, *MORE, *LIKE]
#: What stands around each match while a text is taken apart, and what it is replaced by before; no pattern matches either.
MARK, STAND_IN = "\uffff", "\ufffe"
#: What a text must hold for a kind's pattern to be tried; cheap and never stricter than the pattern.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "national_id": r"[0-9]-[0-9]{2}-[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "local_phone": r"[0-9]{3}[.-][0-9]{4}", "person": r"Mr|Ms|Dr|Prof"}
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"
# Gazetteers (a match makes the vote yes, a value of the second list makes it no).
GAZETTEER = {
    "email": (r"\.(?:com|org|net|edu|gov|io|co|de|fr|es|uk|it|nl|eu|info)$", r"^(?:no-?reply|postmaster|mailer-daemon)@"),
    "ip": (r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.", r"^(?:0|10|127|255|192\.168|169\.254)\."),
    "card": (r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))", r"^0"),
    "phone": (r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])(?![0-9]{15})", r"^\+0"),
    "national_id": (r"^(?!000|666|9)", r"^(?:000|666|9)"),
    "iban": (r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)", r"^(?:XX|ZZ)"),
    "local_phone": (r"^\(?[2-9]", r"^\(?[01]"),
    "person": (r"\x20(?:Anna|Ben|Carl|Clara|David|Elena|Emma|Eva|Frank|Hans|Ines|James|Jean|John|Jose|Juan|Karl|Laura|Luis|Maria|Marie|Mary|Paul|Peter|Robert|Sara|Sophie|Thomas)\b", r"\x20(?:The|And|Of|In)\b"),
}
# Cue words of the context labeler; those of the second list speak against.
CUES = {
    "email": (r"(?i)e-?mail|mail|contact|write|reach", r"(?i)example|sample|test"),
    "ip": (r"(?i)\bip\b|address|host|client|login", r"(?i)version|release|build|section"),
    "card": (r"(?i)card|visa|master|credit|payment|pay", r"(?i)order|serial|isbn|tracking|id"),
    "phone": (r"(?i)phone|call|tel|mobile|fax|contact", r"(?i)version|equation|score"),
    "national_id": (r"(?i)ssn|social|security|id", r"(?i)part|serial|model"),
    "iban": (r"(?i)iban|account|bank|transfer", r"(?i)serial|token|key|hash"),
    "local_phone": (r"(?i)phone|call|tel|mobile|fax", r"(?i)part|serial|version"),
    "person": (r"(?i)dear|by|from|with|signed|contact", r"(?i)street|avenue|company"),
}
AROUND = 40
LABELERS = ("regex", "gazetteer", "context")


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of at least one digit has a valid check digit."""

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, -i, F.lit(1))) - 48
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(x: Column) -> Column:
    """Whether an account number, its first four characters moved to the end and letters read as 10 to 35, is 1 modulo 97."""
    chars = F.concat(F.substring(x, 5, 40), F.substring(x, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(chars, i, F.lit(1)))
        return F.when(c < 58, (rest * 10 + c - 48) % 97).otherwise((rest * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(chars)), F.lit(0), add) == 1


def strict(kind: str, found: Column) -> Column | None:
    """The check that a match must meet beside its pattern: base kinds drop what fails, other kinds vote by it."""
    digits = digits_of(found)
    return {
        "ip": lambda: found.rlike(IP_PARTS),
        "card": lambda: F.length(digits).between(14, 19) & luhn(digits),
        "phone": lambda: F.length(digits).between(10, 15),
        "national_id": lambda: ~found.rlike(r"^(?:000|666|9)|-00-|-0000$"),
        "iban": lambda: mod97(found),
    }.get(kind, lambda: None)()


def fails_by_little(kind: str, found: Column) -> Column:
    """Whether a match of a base kind that fails its check is a candidate of the kind that is like it."""
    n = F.length(digits_of(found))
    return {"ip": found.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), "card": n.between(13, 19), "phone": n.between(7, 17)}[kind]


def begins(lengths: Column) -> Column:
    """The sum of what is before each of lengths, array<long>: sums of blocks of about sqrt(n), then of places in a block,
    since a fold that appends to an array copies it each time."""
    none = F.expr("cast(array() as array<long>)")
    step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(lengths)))).cast("int")

    def scan(a: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("list"))
        return F.aggregate(a, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["list"], F.array(acc["at"])).alias("list")), lambda acc: acc["list"])

    def of(n: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / n).cast("int")), lambda i: F.slice(lengths, i * n + 1, n))

    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    placed = lambda b: F.flatten(F.zip_with(b, scan(F.transform(b, total)), lambda a, at: F.transform(scan(a), lambda x: x + at)))
    return let(let(step, of), placed)


def candidates(text: Column, kind: str) -> Column:
    """All matches of a kind's pattern, leftmost and not overlapping: array of (found, start, end, before, after) in code points.

    One pass of the pattern puts a mark around each match; what lies between the marks is by turns text and match, and
    the lengths of all give the places. A character in the text that is the mark counts as another that matches nothing."""
    none = F.expr("cast(array() as array<struct<found:string,start:long,end:long,before:string,after:string>>)")
    marked = F.regexp_replace(F.translate(text, MARK, STAND_IN), PATTERNS[kind], f"{MARK}$0{MARK}")

    def items(p: Column) -> Column:
        def at(starts: Column, i: Column) -> Column:
            found, start = F.element_at(p, 2 * i), F.element_at(starts, 2 * i)
            return F.struct(found.alias("found"), start.alias("start"), (start + F.length(found)).alias("end"), F.right(F.element_at(p, 2 * i - 1), F.lit(AROUND)).alias("before"), F.left(F.element_at(p, 2 * i + 1), F.lit(AROUND)).alias("after"))

        number = ((F.size(p) - 1) / 2).cast("int")
        lengths = F.transform(p, lambda x: F.length(x).cast("long"))
        return F.when(number > 0, let(let(lengths, begins), lambda starts: F.transform(F.sequence(F.lit(1), number), lambda i: at(starts, i)))).otherwise(none)

    return F.when(text.rlike(NEEDS[kind]), let(F.split(marked, MARK, -1), items)).otherwise(none)


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes & ~no, "1").when(no, "0").otherwise("-")


# --- features of a span -------------------------------------------------------------------------------------------

#: Features of a span by name: how many values each has. A span has one value of each.
VALUES = {"kind": len(KINDS), "length": 4, "digits": 3, "separators": 2, "run": 2, "check": 3, "left": 5, "right": 5, "before": 3, "after": 3}
FIRST = {name: 1 + sum(list(VALUES.values())[:i]) for i, name in enumerate(VALUES)}  # place of a feature's first weight; 0 is the constant


def side(x: Column) -> Column:
    """What stands beside a span: nothing, white space, a letter, a digit, or another sign."""
    return F.when(x == "", 0).when(x.rlike(r"^\s$"), 1).when(x.rlike(r"^\p{L}$"), 2).when(x.rlike(r"^[0-9]$"), 3).otherwise(4)


def span_features(kind: str, like: str, s: Column, check: Column) -> Column:
    """array<int>: the places of a span's features among the weights."""
    n, digits = F.length(s["found"]), F.length(digits_of(s["found"]))
    of_vote = lambda v: F.when(v == "-", 0).when(v == "1", 1).otherwise(2)
    cues = lambda where: of_vote(vote(s[where].rlike(CUES[like][0]), s[where].rlike(CUES[like][1])))
    value = {
        "kind": F.lit(KINDS.index(kind)),
        "length": F.when(n <= 10, 0).when(n <= 15, 1).when(n <= 20, 2).otherwise(3),
        "digits": F.when(digits * 10 < n * 3, 0).when(digits * 10 < n * 8, 1).otherwise(2),
        "separators": s["found"].rlike(r"[\x20().-]").cast("int"),
        "run": s["found"].rlike(r"([0-9])\1{4}").cast("int"),
        "check": of_vote(check),
        "left": side(F.right(s["before"], F.lit(1))),
        "right": side(F.left(s["after"], F.lit(1))),
        "before": cues("before"),
        "after": cues("after"),
    }
    return F.array(*((value[name] + FIRST[name]).cast("int") for name in VALUES))


def labeled(kind: str, found: Column) -> Column:
    """(start, rank, end, kind, votes, features) for matches of a kind; votes has a character a labeler: 1, 0 or - for none.

    A base kind has the matches that meet its check, the kind like it those that fail it by a little."""
    like = LIKE.get(kind, kind)
    has_check = strict(like, F.lit("")) is not None
    if kind in LIKE:
        found = F.filter(found, lambda s: ~strict(like, s["found"]) & fails_by_little(like, s["found"]))
    elif kind in BASE and has_check:
        found = F.filter(found, lambda s: strict(kind, s["found"]))

    def label(s: Column) -> Column:
        check = F.lit("0") if kind in LIKE else F.lit("1") if kind in BASE else F.when(strict(kind, s["found"]), "1").otherwise("0") if has_check else F.lit("-")
        lists = vote(s["found"].rlike(GAZETTEER[like][0]), s["found"].rlike(GAZETTEER[like][1]))
        cues = vote(s["before"].rlike(CUES[like][0]), s["before"].rlike(CUES[like][1]))
        return F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.concat(check, lists, cues).alias("votes"), span_features(kind, like, s, check).alias("features"))

    return F.transform(found, label)


def all_labeled(kinds: list[str], found: Column) -> Column:
    return F.concat(*(labeled(k, found) for k in kinds))


def spans_of(text: Column) -> Column:
    """All candidates of a text by start and rank; a base kind's pattern runs once for the kind and the one like it."""
    parts = []
    for kind in PATTERNS:
        parts.append(let(candidates(text, kind), partial(all_labeled, [kind, *(k for k, of in LIKE.items() if of == kind)])))
    return F.array_sort(F.concat(*parts))


# --- models -------------------------------------------------------------------------------------------------------


def reliabilities(counts: dict[tuple[str, str], int], rounds: int = 60) -> tuple[dict, dict]:
    """Likelihood of each (kind, votes) and each labeler's rates, by expectation-maximisation from the majority of votes."""
    belief = {key: (1 + key[1].count("1")) / (2 + key[1].count("1") + key[1].count("0")) for key in counts}
    rates: dict = {}
    for _ in range(rounds):
        prior: dict = {}
        rates = {(i, y, v): 1.0 + 3.0 * (v == str(y)) for i in range(len(LABELERS)) for y in (0, 1) for v in "10"}
        for (kind, votes), n in counts.items():
            b, p = belief[kind, votes], prior.setdefault(kind, [1.0, 1.0])
            p[0], p[1] = p[0] + n * (1 - b), p[1] + n * b
            for i, v in enumerate(votes):
                if v != "-":
                    rates[i, 1, v] += n * b
                    rates[i, 0, v] += n * (1 - b)
        for i in range(len(LABELERS)):
            for y in (0, 1):
                total = rates[i, y, "1"] + rates[i, y, "0"]
                rates[i, y, "1"], rates[i, y, "0"] = rates[i, y, "1"] / total, rates[i, y, "0"] / total
        for kind, votes in counts:
            odds = math.log(prior[kind][1] / prior[kind][0]) + sum(math.log(rates[i, 1, v] / rates[i, 0, v]) for i, v in enumerate(votes) if v != "-")
            belief[kind, votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return belief, rates


#: Beliefs are summed as whole numbers of this fraction, so that sums do not depend on the order of rows.
UNIT = 1_000_000


def span_classifier(patterns: list[tuple[tuple[int, ...], int, int]], steps: int = 300, shrink: float = 1.0) -> list[float]:
    """Weights of a logistic classifier from (features, spans that have them, sum of their beliefs in UNIT): Newton steps
    weight by weight, damped by the number of features, towards the maximum of the likelihood less shrink * |w|^2 / 2."""
    w = [0.0] * (1 + sum(VALUES.values()))
    rows = [((0, *f), n, total / UNIT) for f, n, total in sorted(patterns)]
    for _ in range(steps if rows else 0):
        g, h = [-shrink * a for a in w], [shrink] * len(w)
        for f, n, total in rows:
            p = chance(w, f)
            for i in f:
                g[i] += total - n * p
                h[i] += n * p * (1 - p)
        w = [a + x / (y * len(VALUES)) for a, x, y in zip(w, g, h, strict=True)]
    return w


def chance(w: list[float], features: tuple[int, ...]) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[i] for i in features)))))


def find_personal_data(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores, n_added, n_rejected, n_overruled) for each row of
    docs (doc_id, text).

    spans lists kind:start:end in code points, by start and then kind: base spans, and those of other kinds to which the
    classifier gives at least the probability least; scores has the probabilities. n_added counts spans of other kinds,
    n_rejected candidates that the classifier did not take, n_overruled decisions of it that go against the majority of
    the votes or settle a tie. Null and empty texts have none. A very long text is one value, scanned once a pattern; its
    matches are held at once. A repeated row or doc_id gives a row each time; other columns are not read; an empty table
    gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    x = docs.select("doc_id", F.when(text.rlike("[0-9@]|Mr|Ms|Dr|Prof"), text).alias("text"))  # no candidate without one of these
    none = F.expr("cast(array() as array<struct<start:long,rank:int,end:long,kind:string,votes:string,features:array<int>>>)")
    x = cut(x.select("doc_id", F.coalesce(F.when(F.col("text").isNotNull(), spans_of(F.col("text"))), none).alias("spans")))
    every = x.where("size(spans) > 0").select(F.explode("spans").alias("s"))
    counts = {(r["kind"], r["votes"]): r["count"] for r in every.groupBy("s.kind", "s.votes").count().collect()}  # kinds times 27 rows at most
    belief = reliabilities(counts)[0]
    known = F.create_map(*(F.lit(v) for (kind, votes), b in sorted(belief.items()) for v in (f"{kind}:{votes}", round(b * UNIT)))) if belief else None
    made = every.groupBy("s.features").agg(F.count(F.lit(1)).alias("n"), F.sum(F.element_at(known, F.concat("s.kind", F.lit(":"), "s.votes"))).alias("b")).collect() if belief else []
    w = span_classifier([(tuple(r["features"]), r["n"], r["b"]) for r in made])  # one row for each combination of features that occurs
    weights = F.array(*map(F.lit, w))
    logit = lambda s: F.aggregate(s["features"], F.lit(w[0]), lambda a, i: a + F.element_at(weights, i + 1))
    scored = F.transform("spans", lambda s: s.withField("score", 1 / (1 + F.exp(-logit(s)))))
    x = x.withColumn("spans", F.when(F.size("spans") > 0, scored).otherwise(F.expr("cast(array() as array<struct<start:long,rank:int,end:long,kind:string,votes:string,features:array<int>,score:double>>)")))
    kept = F.filter("spans", lambda s: (s["rank"] < len(BASE)) | (s["score"] >= least))
    ayes = lambda s, v: F.length(s["votes"]) - F.length(F.replace(s["votes"], F.lit(v), F.lit("")))
    sign = lambda s: F.signum(ayes(s, "1") - ayes(s, "0"))
    settled = F.filter("spans", lambda s: (s["rank"] >= len(BASE)) & (sign(s) != F.when(s["score"] >= least, 1).otherwise(-1)))
    text_of = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    x = x.select("doc_id", "spans", kept.alias("kept"), settled.alias("settled"))
    base = F.filter("kept", lambda s: s["rank"] < len(BASE))
    count = lambda k: F.size(F.filter("kept", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    others = (F.size("kept") - F.size(base)).cast("long").alias("n_added")
    rest = ((F.size("spans") - F.size("kept")).cast("long").alias("n_rejected"), F.size("settled").cast("long").alias("n_overruled"))
    return x.select("doc_id", *map(count, BASE), F.sha2(text_of(base).cast("binary"), 256).alias("base_sha256"), text_of(F.col("kept")).alias("spans"), F.transform("kept", lambda s: s["score"]).alias("scores"), others, *rest)


def op10_personal_data(spark, sf_dir):
    """Personal data in all documents: counts and digest of base spans, all spans, and what the classifier decided."""
    return find_personal_data(table(spark, sf_dir, "documents")).drop("scores")
