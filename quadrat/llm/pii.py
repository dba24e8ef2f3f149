"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, a classifier decides.

Candidates of each kind come from a regular expression. Three labelers vote for, against or not at all on each of them: a
strict pattern, a gazetteer (key words before the span, known endings and prefixes) and the context (what touches the
span). Votes are counted by pattern; a pattern table has at most 3^3 rows a kind, and alone goes to the driver, where EM
estimates each labeler's reliability. Its posteriors then train a naive Bayes span classifier over votes and form features,
again from a table of fixed size, which is applied as a column expression. Base spans (email, ip, card, phone) that pass
their fixed checks always stay; the classifier decides on the other kinds. Everything runs as DataFrame functions within a
row: no text is shuffled.

Defined results: a null text is an empty one, with no spans; repeated rows give repeated results; columns other than the id
and the text are ignored, and may have any name; matches that fail their check are dropped and not tried again; spans of
different kinds may overlap, and all of them stay; texts and spans of any length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import cut

#: Kinds in the order of the result.
BASE_KINDS = ("email", "ip", "card", "phone")
OWN_KINDS = ("secret", "iban", "ssn", "person")
KINDS = BASE_KINDS + OWN_KINDS

#: Possessive forms and look-behinds only keep the engine linear; what they match is what the plain forms match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"""(?i)(?<![a-z])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\x20{0,3}[=:]\x20{0,3}["']?[A-Za-z0-9_./+-]{8,}+["']?""",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "person": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z][a-z]{1,30}(?:\x20[A-Z][a-z]{1,30})?(?![a-z])",
}
#: Cheap tests: a text that fails one has no match of the kind.
GUARDS = {
    "email": ("contains", "@"),
    "ip": ("rlike", r"[0-9]\.[0-9]"),
    "card": ("rlike", r"[0-9][\x20-]?[0-9]"),
    "phone": ("rlike", r"\+[0-9]"),
    "secret": ("rlike", r"(?i)(?:token|secret|passw(?:or)?d|key)\x20{0,3}[=:]"),
    "iban": ("rlike", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]"),
    "ssn": ("rlike", r"[0-9]-[0-9]{2}-[0-9]"),
    "person": ("rlike", r"(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z]"),
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"

#: The strict pattern of each kind, over the span alone.
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$",
    "ip": rf"^{OCTET}(?:\.{OCTET}){{3}}$",
    "card": r"^(?:[0-9]{4}[\x20-]?){3}[0-9]{4,7}$",
    "phone": r"^\+[1-9][0-9]{0,2}[\x20.-]?\(?[0-9]",
    "secret": r"[=:]\x20*[\"']?(?=[^\"']*[0-9])(?=[^\"']*[A-Za-z])[A-Za-z0-9_./+-]{16,}",
    "iban": r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)[0-9]{2}",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "person": r"^(?:Mr|Mrs|Ms|Dr|Prof)\.\x20[A-Z][a-z]+\x20[A-Z][a-z]+$",
}
#: Words that name the kind shortly before a span, or parts of the span that are known.
GAZETTEER = {
    "email": (r"(?i)(?:e-?mail|contact|write|reach|mailto|from)\W{0,4}(?:\w+\W+){0,2}$", r"(?i)\.(?:com|org|net|edu|gov|io|de|fr|es|uk|eu)$"),
    "ip": (r"(?i)(?:\bip\b|address|host|server|from|login)\W{0,4}(?:\w+\W+){0,2}$", r"^(?:10|127|172|192)\."),
    "card": (r"(?i)(?:card|visa|master|amex|credit|pay)\w*\W{0,4}(?:\w+\W+){0,2}$", r"^[3-6]"),
    "phone": (r"(?i)(?:phone|call|tel|mobile|fax|dial)\w*\W{0,4}(?:\w+\W+){0,2}$", r"^\+(?:1|33|34|44|49)(?![0-9]{12})"),
    "secret": (r"(?i)(?:config|env|export|set|my|the)\W{0,4}$", r"(?i)(?:ghp_|sk-|AKIA|[0-9a-f]{32,})"),
    "iban": (r"(?i)(?:iban|account|bank)\W{0,4}(?:\w+\W+){0,2}$", r"^(?:DE|FR|ES|GB)"),
    "ssn": (r"(?i)(?:ssn|social|security)\W{0,4}(?:\w+\W+){0,2}$", r"^[0-8]"),
    "person": (r"(?i)(?:dear|by|name|with|from)\W{0,4}$", r"\x20(?:James|John|Mary|Anna|Peter|Paul|Maria|Smith|Jones|Miller|Martin|Garcia)\b"),
}
CONTEXT = 40
LABELERS = ("strict", "gazetteer", "context")
EM_ROUNDS = 50


def _matches(text: Column, kind: str) -> Column:
    """The candidates of one kind, in order: kind, number, start, end, match, before, after."""
    how, what = GUARDS[kind]
    guard = text.contains(what) if how == "contains" else text.rlike(what)
    pattern = F.lit(PATTERNS[kind])
    gaps = F.split(text, PATTERNS[kind], -1)
    zipped = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"), gaps.alias("g"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("a"))
    parts = F.filter(zipped, lambda z: z["m"].isNotNull())
    nothing = F.array().cast("array<struct<kind:int,s:int,e:int,m:string,b:string,a:string>>")

    def put(acc: Column, z: Column) -> Column:
        start = acc["at"] + F.char_length(z["g"])
        end = start + F.char_length(z["m"])
        one = F.struct(F.lit(KINDS.index(kind)).alias("kind"), start.alias("s"), end.alias("e"), z["m"].alias("m"), F.right(z["g"], F.lit(CONTEXT)).alias("b"), F.left(z["a"], F.lit(1)).alias("a"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    folded = F.aggregate(parts, F.struct(F.lit(0).alias("at"), nothing.alias("out")), put, lambda acc: acc["out"])
    return F.when(guard, folded).otherwise(nothing)


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right."""
    single = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(single, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    """The fixed check of a base kind."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.char_length(digits)
    if kind == "ip":
        return m.rlike(STRICT["ip"])
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _checked(kind: str) -> Column:
    return F.filter(F.col(kind), lambda z: _valid(kind, z["m"]))


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda z: z["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _by_kind(z: Column, of) -> Column:
    out = F.lit(None)
    for k, kind in reversed(list(enumerate(KINDS))):
        out = F.when(z["kind"] == k, of(kind)).otherwise(out)
    return out


def votes(z: Column) -> list[Column]:
    """Of each labeler 1 (for), 0 (against) or null (abstains)."""
    strict = _by_kind(z, lambda k: z["m"].rlike(STRICT[k])).cast("int")
    hint = _by_kind(z, lambda k: F.concat(F.lit(""), z["b"]).rlike(GAZETTEER[k][0]))
    known = _by_kind(z, lambda k: z["m"].rlike(GAZETTEER[k][1]))
    gazetteer = F.when(hint | known, F.lit(1))
    glued = z["b"].rlike(r"[A-Za-z0-9_/=#$%&*-]$") | z["a"].rlike(r"[A-Za-z0-9_/=#$%&*-]")
    context = F.when(glued, F.lit(0)).when(z["b"].rlike(r"(?:^|[\s:;,(\"'<])$"), F.lit(1))
    return [strict, gazetteer.cast("int"), context.cast("int")]


def features(z: Column) -> list[Column]:
    """Form of a span, in a few classes each."""
    n = F.char_length(z["m"])
    digits = F.char_length(F.regexp_replace(z["m"], "[^0-9]", ""))
    return [F.when(n < 12, 0).when(n < 24, 1).when(n < 48, 2).otherwise(3), F.floor(digits * 4 / F.greatest(n, F.lit(1))).cast("int"), F.when(z["m"].rlike("[A-Z]"), 1).otherwise(0)]


def expectation_maximisation(patterns: list[tuple[int, tuple[int | None, ...], int]], rounds: int = EM_ROUNDS) -> tuple[dict, dict]:
    """From (kind, votes, count): the posterior of each (kind, votes), and of each kind (prior, [(p vote 1 | true, p vote 1 | false)])."""
    posterior: dict = {}
    model: dict = {}
    for kind in sorted({k for k, _, _ in patterns}):
        own = [(v, n) for k, v, n in patterns if k == kind]
        rates = [(0.8, 0.2)] * len(LABELERS)
        prior = 0.7
        q: dict = {}
        for _ in range(rounds):
            for v, _ in own:
                yes, no = math.log(prior), math.log(1 - prior)
                for vote, (a, b) in zip(v, rates, strict=True):
                    if vote is not None:
                        yes += math.log(a if vote else 1 - a)
                        no += math.log(b if vote else 1 - b)
                q[v] = 1 / (1 + math.exp(min(700, no - yes)))
            total = sum(n for _, n in own)
            true = sum(q[v] * n for v, n in own)
            prior = (true + 1.4) / (total + 2)
            new = []
            for i in range(len(LABELERS)):
                seen = [(v, n) for v, n in own if v[i] is not None]
                t1, t = sum(q[v] * n for v, n in seen if v[i]), sum(q[v] * n for v, n in seen)
                f1, f = sum((1 - q[v]) * n for v, n in seen if v[i]), sum((1 - q[v]) * n for v, n in seen)
                a, b = (t1 + 8) / (t + 10), (f1 + 2) / (f + 10)
                new.append((max(a, b, 0.5), min(a, b, 0.5)))  # a labeler is never taken for its opposite
            rates = new
        posterior |= {(kind, v): q[v] for v, _ in own}
        model[kind] = (prior, rates)
    return posterior, model


def train_classifier(rows: list[tuple[int, tuple, tuple, int]], posterior: dict) -> dict:
    """Naive Bayes from soft labels. rows: (kind, votes, features, count). By kind: bias, and a weight for each (place, value)."""
    out: dict = {}
    for kind in sorted({r[0] for r in rows}):
        own = [(v + f, posterior[kind, v], n) for k, v, f, n in rows if k == kind]
        true, all_ = sum(p * n for _, p, n in own), sum(n for _, _, n in own)
        bias = math.log((true + 1) / (all_ - true + 1))
        weights = {}
        for place in range(len(own[0][0])):
            values = {x[place] for x, _, _ in own}
            for value in values:
                t = sum(p * n for x, p, n in own if x[place] == value)
                f = sum((1 - p) * n for x, p, n in own if x[place] == value)
                weights[place, value] = math.log((t + 1) / (true + len(values))) - math.log((f + 1) / (all_ - true + len(values)))
        out[kind] = (bias, weights)
    return out


def classifier(model: dict, kind: Column, inputs: list[Column]) -> Column:
    """The log odds of a span as a column; kinds that the model never saw have odds of 1."""
    out = F.lit(0.0)
    for k, (bias, weights) in sorted(model.items()):
        odds = F.lit(bias)
        for place, x in enumerate(inputs):
            score = F.lit(0.0)
            for (at, value), w in sorted(weights.items(), key=str):
                if at == place:
                    score = F.when(x.isNull() if value is None else x == value, F.lit(w)).otherwise(score)
            odds = odds + score
        out = F.when(kind == k, odds).otherwise(out)
    return out


def find_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its id and ``spans``: array of kind (name), s, e (code points, end exclusive), base.

    What was found is not in the result: the places say where it stands in the text.
    """
    own = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    found = own.select("i", *(_matches(F.col("t"), k).alias(k) for k in KINDS))
    checked = [_checked(k) for k in KINDS]
    judged = found.select("i", F.concat(*checked).alias("z"))

    def with_votes(z: Column) -> Column:
        v, f = votes(z), features(z)
        return F.struct(z["kind"].alias("kind"), z["s"].alias("s"), z["e"].alias("e"), *(x.alias(f"v{n}") for n, x in enumerate(v)), *(x.alias(f"f{n}") for n, x in enumerate(f)))

    spans = cut(judged.select("i", F.transform("z", with_votes).alias("z")), "spans")  # places and votes only: what was found is never written
    names = [f"v{n}" for n in range(3)] + [f"f{n}" for n in range(3)]
    counts = spans.select(F.explode("z").alias("z")).groupBy("z.kind", *(f"z.{x}" for x in names)).count().collect()  # bounded: kinds x votes x features
    rows = [(r["kind"], tuple(r[x] for x in names[:3]), tuple(r[x] for x in names[3:]), r["count"]) for r in counts]
    patterns: dict = {}
    for k, v, _, n in rows:
        patterns[k, v] = patterns.get((k, v), 0) + n
    posterior, _ = expectation_maximisation([(k, v, n) for (k, v), n in sorted(patterns.items(), key=str)])
    model = train_classifier(rows, posterior)
    n_base = len(BASE_KINDS)

    def keep(z: Column) -> Column:
        return (z["kind"] < n_base) | (classifier(model, z["kind"], [z[x] for x in names]) >= 0)

    kinds = F.array(*map(F.lit, KINDS))
    named = F.transform(F.filter("z", keep), lambda z: F.struct(F.get(kinds, z["kind"]).alias("kind"), z["s"].alias("s"), z["e"].alias("e"), (z["kind"] < n_base).alias("base")))
    return spans.select(F.col("i").alias(id_col), named.alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda z: F.concat_ws(":", z["kind"], z["s"].cast("string"), z["e"].cast("string"))))


def span_report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts and digests of ``find_spans``."""
    spans = F.col("spans")
    return found.select(id_col, *map(_count, BASE_KINDS), F.sha2(joined(F.filter(spans, lambda z: z["base"])).cast("binary"), 256).alias("base_sha256"), joined(spans).alias("spans"))


def mask(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; where spans overlap, the first stays."""
    ordered = F.array_sort(F.transform("spans", lambda z: F.struct(z["s"].alias("s"), z["e"].alias("e"), z["kind"].alias("kind"))))

    def put(acc: Column, z: Column) -> Column:
        part = F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.greatest(z["s"] - acc["at"], F.lit(0))), F.lit("["), z["kind"], F.lit("]"))
        return F.when(z["s"] >= acc["at"], F.struct(z["e"].alias("at"), part.alias("out"))).otherwise(acc)

    done = F.aggregate(F.col("quadrat_spans"), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), put, lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.lit(2**31 - 1))))
    own = found.select(F.col(id_col).alias("quadrat_id"), ordered.alias("quadrat_spans"))
    return docs.join(own, F.col(id_col) == F.col("quadrat_id"), "left").withColumn(text, F.when(F.size("quadrat_spans") > 0, done).otherwise(F.col(text))).drop("quadrat_id", "quadrat_spans")
