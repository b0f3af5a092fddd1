"""Personal data by weak supervision, in DataFrame functions only.

Base spans come from four fixed patterns with their checks. They are never taken away. Candidates for further spans come
from wide patterns: secrets (keys, tokens, passwords), IBANs, national ids, birth dates, names, street addresses and phone
numbers without a country code. Every base span and every candidate gets the votes of four labelers: its strict shape
(regex), a gazetteer (given names, street words, country and issuer codes, key prefixes, mail domains), the cue words before
it (context), and its content (checksums, the mix of characters, its place in the sentence). For each kind,
expectation-maximisation over the counts of vote patterns estimates the labelers' reliabilities without labels: the table of
patterns has at most 4 * 3**4 rows for a kind, whatever the corpus. The final span classifier is naive Bayes: the odds
of a span's votes under these reliabilities, times the likelihood ratios of the span's own features, which are trained with
the patterns' posterior as soft labels; its counts are aggregates as well, and no vote is also a feature. A candidate whose
posterior reaches ``accept`` becomes a span of its kind, unless a base span overlaps it; base spans carry their
posterior as ``confidence``.

Positions are code points, ends exclusive. Spark has no function for match positions, so a text is split by the
pattern: the pieces' and the matches' lengths alternate and their running sum gives the positions. Running sums and
maxima go in blocks of ``BLOCK`` (an ``aggregate`` copies its buffer at each step), so a text with many thousand spans takes
time in proportion. All patterns begin only where a run begins (or where the last match ended) and are possessive, but
for ``phone``, which gives back trailing marks.

Defined results: a null text is empty; a text without spans has counts 0 and empty lists. Repeated rows are handled
each for itself. An empty table, or one without candidates, trains nothing and adds nothing. Extra columns are ignored;
names that begin with ``pii_`` or ``_pii_`` are the operator's own.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import materialise, text_or_empty

KINDS = ("email", "ip", "card", "phone")
ADDED = ("secret", "iban", "national_id", "birth_date", "name", "address", "local_phone")
BLOCK = 128
CONTEXT_CHARS = 32

# The base patterns, in possessive form where that keeps their matches.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

# Gazetteers.
GIVEN_NAMES = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew George Kevin Brian Edward Peter Henry Mary Patricia Jennifer Linda Elizabeth "
    "Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Emily Anna Laura Julia Alice Hans Klaus Jürgen Wolfgang Stefan Andreas Petra Sabine Monika Ursula Heike Jean Pierre Michel Philippe François "
    "Marie Nathalie Isabelle Catherine Sophie José Juan Antonio Manuel Francisco Carlos Miguel Pedro María Carmen Josefa Dolores Pilar Lucía"
)
STREET_WORDS = "Street St Avenue Ave Road Rd Lane Ln Drive Dr Boulevard Blvd Court Ct Square Terrace"
IBAN_COUNTRIES = "AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK TR"

_W = "[A-ZÄÖÜÀÉÈÇÑ][a-zäöüßàáéèêçñíóúâôîû]++"
CANDIDATES = {
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{12,}+",
    "iban": r"(?=[A-Z])(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "national_id": r"(?=[0-9])(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "birth_date": r"(?=[0-9])(?<![0-9./-])(?:[0-3]?[0-9][./-][01]?[0-9][./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9])(?![0-9/-])",
    "name": rf"(?=[A-ZÄÖÜÀÉÈÇÑ])(?<![A-Za-z0-9@._-]){_W}(?:\x20{_W}){{1,2}}+(?![A-Za-z0-9@])",
    "address": rf"(?=[0-9A-ZÄÖÜ])(?<![A-Za-z0-9])(?:[0-9]{{1,5}}+(?:\x20{_W}){{1,3}}?\x20(?:{STREET_WORDS.replace(' ', '|')})(?![A-Za-z])|[A-ZÄÖÜ][a-zäöü]*?(?:straße|strasse|platz|allee|gasse)\x20[0-9]{{1,4}}+[a-z]?|(?:Calle|Avenida|Plaza|Rue|Boulevard)\x20(?:(?:de|del|la|du|des|le)\x20)*+{_W}(?:\x20{_W})?+,?\x20[0-9]{{1,4}}+)",
    "local_phone": r"(?=[0-9(])(?<![0-9A-Za-z+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
}


@dataclass(frozen=True)
class Rule:
    """What the labelers of a kind look for; a regex that does not match votes against where ``strict`` names its labeler, else abstains."""

    shape: str
    gazetteer: str
    cue: str
    against: str = ""  # a shape that votes against
    strict: str = ""


# Strict shapes, gazetteers and cue words. Cues stand at the end of the words before a span.
RULES = {
    "email": Rule(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}$", r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$", "mail|contact|kontakt|correo|courriel|write to|reach", strict="shape"),
    "ip": Rule(r"^(?:[1-9][0-9]?[0-9]?\.)(?:(?:0|[1-9][0-9]{0,2})\.){2}(?:0|[1-9][0-9]{0,2})$", r"^(?:10|127|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\.", r"\bip|address|host|server|from|login", against=r"^0", strict="shape"),
    "card": Rule(r"^(?:[0-9]{4}[\x20-]?){3}[0-9]{4}$|^[0-9]{14,19}$", r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))", "card|visa|master|amex|karte|tarjeta|carte|credit", strict="shape"),
    "phone": Rule(r"^\+[1-9][0-9]{0,2}[\x20.-]?(?:\([0-9]{1,4}\))?[\x20.-]?[0-9]", r"^\+(?:1|7|2[07]|3[0-469]|4[0134-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])", "phone|tel|call|fax|mobil|handy|anruf|llam|appel", strict="shape"),
    "secret": Rule(r"^(?:[0-9a-f]{16,}|[0-9A-F]{16,}|(?:AKIA|ASIA)[A-Z0-9]{12,}|(?:gh[pousr]_|sk-|pk_|xox.-|eyJ|AIza)[A-Za-z0-9_-]{16,})$", r"^(?:AKIA|ASIA|gh[pousr]_|sk-|pk_|xox|eyJ|AIza)", r"token|secret|passw|passwort|contrase|mot de passe|api.?key|\bkey|credential|clave|schl.ssel", against="^[A-Za-z]+[-/][A-Za-z]+|[a-z]{6,}$"),
    "iban": Rule(r"^[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){3,7}(?:\x20?[0-9A-Z]{1,3})?$", rf"^(?:{IBAN_COUNTRIES.replace(' ', '|')})", "iban|account|konto|cuenta|compte|bank", strict="shape gazetteer"),
    "national_id": Rule(r"^[0-9]{3}-", r"^$", r"ssn|social|security|national|sozialvers|seguridad|identi|\bid", strict="shape"),
    "birth_date": Rule(r"^$", r"^$", r"born|birth|\bdob|geboren|geburts|nacid|nacimiento|\bnée?\b|naissance", strict="cue"),
    "name": Rule(r"^[^ ]{2,}(?: [^ ]{2,})+$", rf"^(?:{GIVEN_NAMES.replace(' ', '|')}) ", r"\bmrs?\.?|\bms|\bdr|name is|i am|signed|regards|sincerely|herr|frau|señor|señora|monsieur|madame|\bname", strict="gazetteer"),
    "address": Rule(r"[A-Za-zß]+.*[0-9]|[0-9]+ [A-Z]", rf"(?:{STREET_WORDS.replace(' ', '|')})$|(?:straße|strasse|platz|allee|gasse)|^(?:Calle|Avenida|Plaza|Rue|Boulevard)", "address|live|lives|at|wohn|adresse|direcci|domicili|habite|street", strict="gazetteer"),
    "local_phone": Rule(r"^\(?[2-9][0-9]{2}\)?[\x20.-]?[2-9][0-9]{2}[\x20.-][0-9]{4}$", r"^\(?(?:2(?:0[1-9]|1[0-9])|3[0-9]{2}|4[0-9]{2}|5[0-9]{2}|6[0-9]{2}|7[0-9]{2}|8[0-9]{2}|9[0-9]{2})", "phone|tel|call|fax|mobil|handy|anruf|llam|appel|cell", strict="shape cue"),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where a lambda uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """The running sum (or maximum, by ``join``) of an array of ints, each place included, in blocks."""
    none = F.array().cast("array<int>")

    def append(acc: Column, v: Column) -> Column:
        return F.concat(acc, F.array(F.when(F.size(acc) > 0, join(F.element_at(acc, -1), v)).otherwise(v)))

    def blocks(all_: Column) -> Column:
        starts = F.sequence(F.lit(0), (F.size(all_) - 1).cast("int"), F.lit(BLOCK))
        return F.transform(starts, lambda b: F.aggregate(F.slice(all_, b + 1, F.lit(BLOCK)), none, append))

    def carried(inner: Column) -> Column:
        tops = F.aggregate(F.transform(inner, lambda x: F.element_at(x, -1)), none, append)
        return let(tops, lambda t: F.flatten(F.transform(inner, lambda x, i: F.when(i == 0, x).otherwise(F.transform(x, lambda v: join(F.get(t, i - 1), v))))))

    return F.when(F.size(values) == 0, none).otherwise(let(values, lambda v: let(blocks(v), carried)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.transform(F.split(F.reverse(_digits(value)), ""), lambda d: F.try_to_number(d, F.lit("9")).cast("int"))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _checksum(value: Column) -> Column:
    """The remainder by 97 of an IBAN, its first four characters put last and letters read as numbers."""
    plain = F.regexp_replace(value, " ", "")
    signs = F.split(F.concat(F.substring(plain, 5, 99), F.substring(plain, 1, 4)), "")
    return F.aggregate(F.filter(signs, lambda c: c != ""), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(_digits(value)).between(14, 19), _luhn(value)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    if kind == "iban":
        return _checksum(value) == 1
    if kind == "national_id":
        return value.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)")
    return F.lit(True)


def _located(found: Column, pieces: Column) -> Column:
    """Matches and the pieces between them, as spans with the characters before each."""

    def spans(values: Column, gaps: Column) -> Column:
        ends = running(F.transform(values, lambda v, i: F.length(v) + F.length(F.get(gaps, i))), lambda a, x: a + x)
        return let(ends, lambda e: F.transform(values, lambda v, i: F.struct((F.get(e, i) - F.length(v)).alias("start"), F.get(e, i).alias("end"), v.alias("value"), F.right(F.get(gaps, i), F.lit(CONTEXT_CHARS)).alias("before"))))

    return let(found, lambda values: let(pieces, lambda gaps: spans(values, gaps)))


def located_spans(docs: DataFrame, text: Column, kinds: dict[str, str]) -> DataFrame:
    """Add a column ``_pii_<kind>`` of located matches for each pattern; the regular expressions run once where nothing matches."""
    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string>>")
    out = docs.withColumn("_pii_text", text)
    # every pattern but two needs a digit, and one an at sign: a text without is not searched for it
    out = out.withColumn("_pii_digit", F.col("_pii_text").rlike("[0-9]"))
    needs = {"email": F.contains(F.col("_pii_text"), F.lit("@")), "name": F.lit(True)}
    out = out.withColumns({f"_pii_f_{k}": F.when(needs.get(k, F.col("_pii_digit")), F.regexp_extract_all("_pii_text", F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>")) for k, p in kinds.items()})
    out = out.withColumns({f"_pii_{k}": F.when(F.size(f"_pii_f_{k}") > 0, _located(F.col(f"_pii_f_{k}"), F.split("_pii_text", p, -1))).otherwise(none) for k, p in kinds.items()})
    return out.drop("_pii_digit", *[f"_pii_f_{k}" for k in kinds])


def _share(value: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(value, pattern, "")) / F.length(value)


def _content(kind: str, v: Column, before: Column) -> Column:
    """The vote of what a span holds: 1, 0, or null."""
    if kind == "secret":
        return F.when((_share(v, "[^0-9]") >= 0.1) & (_share(v, "[^A-Za-z]") >= 0.1) & (F.size(F.array_distinct(F.split(v, ""))) >= 8), 1).otherwise(0)
    if kind == "name":  # at a sentence's start a capital says nothing
        return F.when(before.rlike(r"(?:^|[.!?:;\n])\s*$"), 0)
    if kind in ("card", "national_id", "local_phone"):
        return F.when(F.size(F.array_distinct(F.split(_digits(v), ""))) <= 2, 0)
    return F.lit(None).cast("int")


def _judged(kind: str, span: Column) -> Column:
    """The votes of the labelers (1 for, 0 against, -1 abstains) and the features of a span, as one struct."""
    v, before, rule = span["value"], span["before"], RULES[kind]
    digits = _share(v, "[^0-9]")

    def vote(matched: Column, labeler: str, against: Column | None = None) -> Column:
        out = F.when(matched, 1)
        if against is not None:
            out = out.when(against, 0)
        return F.coalesce(out.otherwise(0 if labeler in rule.strict.split() else -1), F.lit(-1))

    votes = {
        "shape": vote(v.rlike(rule.shape), "shape", v.rlike(rule.against) if rule.against else None),
        "gazetteer": vote(v.rlike(rule.gazetteer), "gazetteer"),
        "cue": vote(before.rlike(rf"(?i)(?:{rule.cue})[\w ]{{0,12}}[\"'=:., ]*$"), "cue"),
        "content": F.coalesce(_content(kind, v, before).cast("int"), F.lit(-1)),
    }
    features = {
        "size": F.when(F.length(v) < 16, "short").when(F.length(v) < 24, "middle").otherwise("long"),
        "case": F.when(v.rlike("[a-z]") & v.rlike("[A-Z]"), "mixed").when(v.rlike("[A-Z]"), "upper").otherwise("lower"),
        "digits": F.floor(digits * 4).cast("string"),
        "marks": v.rlike("[_+/-]").cast("string"),
        "quoted": before.rlike("[\"'=]$").cast("string"),
        "hex": v.rlike("^[0-9A-Fa-f]+$").cast("string"),
    }
    return F.struct(F.lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end"), *[x.cast("int").alias(f"vote_{k}") for k, x in votes.items()], *[x.alias(f"is_{k}") for k, x in features.items()])


VOTES = ("shape", "gazetteer", "cue", "content")
FEATURES = ("size", "case", "digits", "marks", "quoted", "hex")


def reliabilities(patterns: dict[tuple[int, ...], float], rounds: int = 50) -> tuple[float, list[float]]:
    """Expectation-maximisation: the share of true spans, and each labeler's accuracy where it doesn't abstain.

    Votes are independent given the truth; an abstention says nothing. Accuracies stay within 0.55 and 0.99, so that a labeler
    is never turned round. Begins with the majority of the votes.
    """
    weight = sum(patterns.values())
    belief = {p: (0.9 if sum(1 if v == 1 else -1 if v == 0 else 0 for v in p) > 0 else 0.1) for p in patterns}
    prior, accuracy = 0.5, [0.75] * len(VOTES)
    for _ in range(rounds):
        prior = min(0.9, max(0.1, sum(n * belief[p] for p, n in patterns.items()) / weight))
        for k in range(len(VOTES)):
            right = sum(n * (belief[p] if p[k] == 1 else 1 - belief[p]) for p, n in patterns.items() if p[k] >= 0)
            voted = sum(n for p, n in patterns.items() if p[k] >= 0)
            accuracy[k] = min(0.99, max(0.55, (right + 1.5) / (voted + 2)))
        belief = {p: posterior(p, prior, accuracy) for p in patterns}
    return prior, accuracy


def posterior(votes: tuple[int, ...], prior: float, accuracy: list[float]) -> float:
    odds = math.log(prior / (1 - prior)) + sum((1 if v else -1) * math.log(a / (1 - a)) for v, a in zip(votes, accuracy, strict=True) if v >= 0)
    return 1 / (1 + math.exp(-odds))


@dataclass
class SpanModel:
    """For each kind the prior log odds and the labelers' accuracies, and the log likelihood ratios of feature values."""

    priors: dict[str, float]
    accuracies: dict[str, list[float]]
    ratios: dict[tuple[str, str, str], float]

    def odds(self, c: Column) -> Column:
        """Log odds of a judged span."""
        known = lambda table: F.create_map(*[x for k, v in sorted(table.items()) for x in (F.lit(k), F.lit(float(v)))])
        total = F.element_at(known(self.priors), c["kind"])
        for k, labeler in enumerate(VOTES):
            says = known({kind: math.log(a[k] / (1 - a[k])) for kind, a in self.accuracies.items()})
            total = total + F.element_at(says, c["kind"]) * F.when(c[f"vote_{labeler}"] == 1, 1.0).when(c[f"vote_{labeler}"] == 0, -1.0).otherwise(0.0)
        for f in FEATURES:
            ratio = known({f"{kind}|{value}": w for (kind, name, value), w in self.ratios.items() if name == f})
            total = total + F.coalesce(F.element_at(ratio, F.concat_ws("|", c["kind"], c[f"is_{f}"])), F.lit(0.0))
        return total


def train(spans: DataFrame, column: str = "_pii_judged") -> SpanModel | None:
    """The span model from the judged spans of all rows; None without any."""
    flat = spans.select(F.explode(column).alias("c")).select("c.kind", *[F.col(f"c.vote_{v}") for v in VOTES], *[F.col(f"c.is_{f}") for f in FEATURES])
    counted = flat.groupBy(*flat.columns).count().collect()  # for each of the kinds at most 3**4 vote patterns times 360 feature tuples
    if not counted:
        return None
    model = SpanModel({}, {}, {})
    for kind in sorted({r["kind"] for r in counted}):
        own = [r for r in counted if r["kind"] == kind]
        patterns: dict[tuple[int, ...], float] = defaultdict(float)
        for r in own:
            patterns[tuple(r[f"vote_{v}"] for v in VOTES)] += r["count"]
        prior, accuracy = reliabilities(patterns)
        model.priors[kind], model.accuracies[kind] = math.log(prior / (1 - prior)), accuracy
        yes = no = 0.0
        cells: dict[tuple[str, str], list[float]] = defaultdict(lambda: [0.0, 0.0])
        for r in own:
            p = posterior(tuple(r[f"vote_{v}"] for v in VOTES), prior, accuracy)
            yes, no = yes + p * r["count"], no + (1 - p) * r["count"]
            for f in FEATURES:
                cell = cells[f, r[f"is_{f}"]]
                cell[0] += p * r["count"]
                cell[1] += (1 - p) * r["count"]
        for (f, value), (a, b) in cells.items():
            # log ratio of the value's shares in the two classes, each drawn towards its share in all spans
            share = (a + b) / (yes + no)
            ratio = math.log((a + share) / (yes + 1)) - math.log((b + share) / (no + 1))
            model.ratios[kind, f, value] = min(2.0, max(-2.0, ratio))
    return model


def _found(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``pii_counts`` and the judged spans of all kinds, base spans first."""
    found = located_spans(docs, text_or_empty(text_col), {**PATTERNS, **CANDIDATES})
    checked = lambda k: F.filter(f"_pii_{k}", lambda s: _valid(k, s["value"]))
    judges = lambda k: F.transform(f"_pii_{k}", lambda s: _judged(k, s))
    found = found.withColumns({f"_pii_{k}": checked(k) for k in (*KINDS, "iban", "national_id")})
    judged = F.concat(*map(judges, (*KINDS, *ADDED)))
    counts = F.struct(*[F.size(f"_pii_{k}").cast("long").alias(k) for k in KINDS])
    return found.withColumn("_pii_judged", judged).withColumn("pii_counts", counts).drop(*[f"_pii_{k}" for k in (*KINDS, *ADDED)])


def _free(spans: Column) -> Column:
    """Of spans sorted by start, the base spans, and those of other kinds that no base span overlaps."""
    base = lambda s: s["order"] < len(KINDS)
    reach = running(F.transform(spans, lambda s: F.when(base(s), s["end"]).otherwise(0)), F.greatest)
    ahead = F.reverse(running(F.transform(F.reverse(spans), lambda s: F.when(base(s), s["start"]).otherwise(2**31 - 1)), F.least))
    # a base span that sorts before and reaches beyond its start, or that sorts behind and starts before its end
    return let(reach, lambda r: let(ahead, lambda a: F.filter(spans, lambda s, i: base(s) | ((F.get(r, i) <= s["start"]) & (F.get(a, i) >= s["end"])))))


def with_spans(docs: DataFrame, text_col: str = "text", accept: float = 0.5, keep_text: bool = False) -> DataFrame:
    """``docs`` with ``pii_base`` (valid base spans of the four kinds, by start and kind), ``pii_counts`` and ``pii_spans`` (base and added).

    A span is (start, order, end, kind, confidence). Without ``keep_text`` the text column goes and the spans are found once and
    stored. With it only the judged spans are stored for training, and the texts are scanned again where they are used,
    so that they are not copied to disk.
    """
    if keep_text:
        model = train(materialise(_found(docs.select(text_col), text_col).select("_pii_judged"), "candidates"))
        stored = _found(docs, text_col)
    else:
        stored = materialise(_found(docs, text_col).drop("_pii_text", text_col), "spans")
        model = train(stored)
    model = model or SpanModel(dict.fromkeys(KINDS, 0.0), {k: [0.5] * len(VOTES) for k in KINDS}, {})
    order = F.create_map(*[x for i, k in enumerate((*KINDS, *ADDED)) for x in (F.lit(k), F.lit(i))])

    def span(c: Column) -> Column:
        return F.struct(c["start"].alias("start"), F.element_at(order, c["kind"]).alias("order"), c["end"].alias("end"), c["kind"].alias("kind"), (1 / (1 + F.exp(-model.odds(c)))).alias("confidence"))

    scored = F.array_sort(F.transform("_pii_judged", span))
    likely = let(scored, lambda all_: F.filter(all_, lambda s: (s["order"] < len(KINDS)) | (s["confidence"] >= accept)))
    stored = stored.withColumn("pii_spans", F.when(F.size("_pii_judged") == 0, F.array().cast(SPANS)).otherwise(let(likely, _free).cast(SPANS)))
    return stored.withColumn("pii_base", F.filter("pii_spans", lambda s: s["order"] < len(KINDS))).drop("_pii_judged")


SPANS = "array<struct<start:int,order:int,end:int,kind:string,confidence:double>>"


def span_list(spans: Column | str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column | str) -> Column:
    """``text`` with each span, or run of overlapping spans, replaced by its first kind in angle brackets."""
    given = F.col(spans) if isinstance(spans, str) else spans

    def runs(all_: Column, reach: Column) -> Column:
        """(from, start, kind) of each span that starts a run: the text from the end of the run before it goes before it."""
        before = lambda i: F.when(i > 0, F.get(reach, i - 1)).otherwise(0)
        own = F.transform(all_, lambda s, i: F.struct(before(i).alias("at"), s["start"].alias("start"), s["kind"].alias("kind")))
        return F.filter(own, lambda r: r["start"] >= r["at"])

    def blocks(heads: Column, last: Column) -> Column:
        """Runs go in blocks, each cut out of the text once, as a substring is counted from the text's start."""

        def block(b: Column) -> Column:
            own = F.slice(heads, b + 1, F.lit(BLOCK))
            stop = F.coalesce(F.get(heads, b + BLOCK)["at"], last)
            begin = F.get(heads, b)["at"]
            part = lambda cut, a, z: F.substring(cut, a - begin + 1, z - a)
            return let(F.substring(text, begin + 1, stop - begin), lambda cut: F.array_join(F.transform(own, lambda r: F.concat(part(cut, r["at"], r["start"]), F.lit("<"), r["kind"], F.lit(">"))), ""))

        return F.array_join(F.transform(F.sequence(F.lit(0), (F.size(heads) - 1).cast("int"), F.lit(BLOCK)), block), "")

    def whole(all_: Column) -> Column:
        reach = running(F.transform(all_, lambda s: s["end"]), F.greatest)
        return let(reach, lambda r: let(runs(all_, r), lambda h: F.concat(blocks(h, F.element_at(r, -1)), F.substring(text, F.element_at(r, -1) + 1, F.length(text)))))

    return F.when(F.size(given) == 0, text).otherwise(let(given, whole))
