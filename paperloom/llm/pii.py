"""Personal data: base patterns, and weakly supervised spans, in DataFrame functions throughout."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.batches import cut

#: The base patterns. Possessive repeats and look-behinds match what the plain forms match, leftmost and without overlap,
#: but in time linear in the text: a run of characters is tried from its start (or from the end of the last match) alone.
LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Candidates of the method, by kind: wide nets whose catch the labelers vote on.
CANDIDATES = {
    "secret": r"(?<![A-Za-z0-9_+/=@-])[A-Za-z0-9_+/=-]{16,}+(?!@)",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+(?![A-Za-z0-9])",
    "spelled_email": r"(?<![A-Za-z0-9])[A-Za-z0-9._-]{1,64}+ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}+(?: ?[\[(](?:dot|DOT)[\])] ?[A-Za-z0-9-]{1,63}+)++",
    "person": r"(?<![\p{L}\p{N}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame)\.? \p{Lu}\p{L}{1,30}+(?: \p{Lu}\p{L}{1,30}+)?",
}
#: Gazetteers: words before a span that announce private data, words that announce public data, and common given names.
PRIVATE_WORDS = ("token", "secret", "password", "passwd", "api key", "api_key", "apikey", "auth", "bearer", "ssn", "social security", "iban", "account", "contact", "e-mail", "email", "mail", "name is", "signed", "sincerely", "patient", "regards")
PUBLIC_WORDS = ("commit", "sha", "sha1", "sha256", "md5", "checksum", "digest", "revision", "isbn", "issn", "doi", "version", "build", "uuid", "figure", "table", "chapter", "part", "model", "catalogue", "film", "brand")
GIVEN_NAMES = ("James", "Mary", "John", "Patricia", "Robert", "Jennifer", "Michael", "Linda", "David", "Elizabeth", "William", "Maria", "Thomas", "Anna", "Peter", "Laura", "Hans", "Sabine", "Klaus", "Ursula", "Pierre", "Marie", "Jean", "Sophie", "Luc", "Carlos", "Carmen", "José", "Lucia", "Juan")
#: Characters before and after a span that context labelers see.
CONTEXT = 32
#: Labelers, and how often a vote of each is thought to be right before any data are seen.
LABELERS = {"announced": 0.9, "assigned": 0.8, "gazetteer": 0.8, "structure": 0.75, "followed": 0.75}
#: What those beliefs weigh, in votes; the share of candidates on which a labeler is thought to have an opinion.
BELIEF, OPINION = 10, 0.6
EM_ROUNDS, FIT_ROUNDS = 60, 400


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, doubled(d.cast("int"))).otherwise(d.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return x.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(_digits(x)).between(16, 19), _luhn(_digits(x))).otherwise(False)
    return F.length(_digits(x)).between(8, 15)


def _mod97(x: Column) -> Column:
    """The remainder that an account number's check digits make 1: letters count as 10 to 35, the first four characters come last."""
    moved = F.concat(F.substring(x, 5, 40), F.substring(x, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97))


def _distinct(x: Column) -> Column:
    return F.size(F.array_distinct(F.split(x, "")))


def _words(which: tuple[str, ...]) -> str:
    return r"(?i)(?<![\p{L}\p{N}])(?:" + "|".join(which) + r")[\s\"'=:(\[]*$"


def _near(which: tuple[str, ...]) -> str:
    return r"(?i)^[^.!?\n]*?(?<![\p{L}\p{N}])(?:" + "|".join(which) + r")(?![\p{L}\p{N}])"


def votes(kind: Column, x: Column, before: Column, after: Column) -> dict[str, Column]:
    """Each labeler's vote on a candidate: 1 private, -1 not, 0 no opinion."""
    vote = lambda yes, no=None: F.when(yes, 1).when(no if no is not None else F.lit(False), -1).otherwise(0)
    secret, person = kind == "secret", kind == "person"
    named = x.rlike(" (?:" + "|".join(GIVEN_NAMES) + ")(?: |$)")
    # All that the characters of a span tell is one labeler, as parts of it would agree for no other reason.
    digits = F.regexp_count(x, F.lit("[0-9]"))
    sound = (
        F.when(kind == "iban", _mod97(x) == 1)
        .when(kind == "national_id", x.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"))
        .when(kind == "spelled_email", x.rlike("(?:dot|DOT)[\\])] ?[A-Za-z]{2,6}$"))
        .when(secret & ((digits == 0) | x.rlike("^[0-9-]+$|[-_/+=]{2,}|^(?:[A-Za-z]?[a-z]{2,}+[-_/+=]*+)++[0-9]{0,4}$") | (_distinct(x) < 8)), F.lit(False))
        .when(secret & (_distinct(x) >= 11) & (digits * 16 >= F.length(x)), F.lit(True))
    )
    return {
        "announced": vote(before.rlike(_words(PRIVATE_WORDS)), before.rlike(_words(PUBLIC_WORDS))),
        "assigned": vote(before.rlike("[=:]\\s*[\"']?$"), before.rlike("[/\\\\.@#]$")),
        "gazetteer": vote(person & named, person | after.rlike("^(?:/|\\.(?:html?|php|png|jpe?g|js|css|zip|gz))")),
        "structure": vote(F.coalesce(sound, F.lit(False)), ~F.coalesce(sound, F.lit(True))),
        "followed": vote(after.rlike(_near(PRIVATE_WORDS)), after.rlike(_near(PUBLIC_WORDS))),
    }


_SPAN = "struct<kind:string,start:int,stop:int,value:string,before:string,after:string>"
_LENGTHS = (20, 28, 36)


def traits(c: Column) -> dict[str, Column]:
    """What the classifier sees of a candidate: its kind, features of the span, and of what stands around it. None is a vote; each has few values."""
    x, before = c["value"], c["before"]
    share = lambda pattern: F.regexp_count(x, F.lit(pattern)) * 4 / F.length(x)
    steps = F.lit(0)
    for n in _LENGTHS:
        steps = steps + F.when(F.length(x) >= n, 1).otherwise(0)
    return {
        "kind": c["kind"],
        "length": steps,
        "digits": F.least(F.ceil(share("[0-9]")), F.lit(2)).cast("int"),
        "capitals": F.least(F.ceil(share("[A-Z]")), F.lit(2)).cast("int"),
        "kinds_of_characters": F.when(_distinct(x) >= 11, 2).when(_distinct(x) >= 8, 1).otherwise(0),
        "sound": F.when((c["kind"] == "iban") & (_mod97(x) == 1) | (c["kind"] == "person") & x.rlike("\\. \\p{Lu}\\p{L}+ \\p{Lu}") | (c["kind"] == "national_id") & ~x.rlike("^(?:000|666|9)|-00-|0000$"), 1).otherwise(0),
        "lead": F.when(before.rlike("[=:]\\s*[\"']?$"), 2).when(before.rlike("\\s$|^$"), 0).otherwise(1),
        "topic": F.when(before.rlike(_words(PRIVATE_WORDS)), 2).when(before.rlike(_words(PUBLIC_WORDS)), 0).otherwise(1),
    }


#: The most patterns of traits that come to the driver: all there can be.
PATTERNS = 5 * 4 * 3 * 3 * 3 * 2 * 3 * 3


def _matches(rows: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """rows with _found and _gaps of each pattern: the matches in _text, and the text around them where there are any."""
    needs = {"email": "@", "phone": "+", "national_id": "-"}
    none = F.array().cast("array<string>")
    found = {f"_found_{k}": F.when(F.contains("_text", F.lit(needs[k])) if k in needs else F.lit(True), F.regexp_extract_all("_text", F.lit(p), F.lit(0))).otherwise(none) for k, p in patterns.items()}
    rows = rows.select("*", *(c.alias(n) for n, c in found.items()))
    gaps = (F.when(F.size(f"_found_{k}") > 0, F.split("_text", p, -1)).otherwise(none).alias(f"_gaps_{k}") for k, p in patterns.items())
    return rows.select("*", *gaps)


#: Matches of a text whose positions are added up at once; the sums of such blocks are added up in turn, so that no list is rebuilt for each match.
BLOCK = 128


def _spans(kind: str, keep) -> Column:
    """The matches of a kind that keep(value) accepts, as an array of _SPAN; positions in code points, end exclusive.

    The lengths of gaps and matches add up to positions.
    """
    gaps, found = F.col(f"_gaps_{kind}"), F.col(f"_found_{kind}")
    none, places = F.array().cast(f"array<{_SPAN}>"), F.array().cast("array<int>")
    last = F.size(found) - 1
    of = lambda b: F.sequence(b, F.least(b + (BLOCK - 1), last))

    def step(a: Column, i: Column) -> Column:
        x, gap = F.get(found, i), F.get(gaps, i)
        start = a["at"] + F.length(gap)
        stop = start + F.length(x)
        row = F.struct(F.lit(kind).alias("kind"), start.alias("start"), stop.alias("stop"), x.alias("value"), F.right(gap, F.lit(CONTEXT)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(CONTEXT)).alias("after"))
        return F.struct(stop.alias("at"), F.when(keep(x), F.concat(a["spans"], F.array(row))).otherwise(a["spans"]).cast(f"array<{_SPAN}>").alias("spans"))

    def add(a: Column, b: Column) -> Column:
        length = F.aggregate(of(b), F.lit(0), lambda n, i: n + F.length(F.get(gaps, i)) + F.length(F.get(found, i)))
        return F.struct((a["at"] + length).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts"))

    blocks = F.sequence(F.lit(0), last, F.lit(BLOCK))
    starts = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), places.alias("starts")), add, lambda a: a["starts"])
    within = lambda at, k: F.aggregate(of(k * BLOCK), F.struct(at.alias("at"), none.alias("spans")), step, lambda a: a["spans"])
    return F.when(F.size(found) > 0, F.flatten(F.transform(starts, within))).otherwise(none)


def _keeper(test, kind: str):
    return lambda x: test(kind, x)


@dataclass(frozen=True)
class SpanModel:
    """By kind and labeler: how much a vote for private speaks for it (0.5: nothing). And the span classifier's weights by feature."""

    reliability: dict[tuple[str, str], float]
    weights: dict[str, float]

    def log_odds(self, c: Column) -> Column:
        """The classifier: a sum of weights of the features that a candidate has."""
        values = traits(c)
        total = F.lit(self.weights.get("bias", 0.0))
        for feature, w in self.weights.items():
            if feature != "bias":
                kind, _, (name, _, value) = (*feature.partition(":")[:2], feature.partition(":")[2].partition("="))
                same = values[name] == (value if name == "kind" else int(value))
                total = total + F.when(same if name == "kind" else (values["kind"] == kind) & same, w).otherwise(0.0)
        return total


def _features(r: dict) -> list[str]:
    """The features of a pattern of traits: its kind, and each trait by itself for that kind."""
    return ["bias", f"{r['kind']}:kind={r['kind']}", *(f"{r['kind']}:{k}={v}" for k, v in r.items() if k not in ("kind", "n", "p"))]


_logit = lambda p: math.log(p / (1 - p))
_sigmoid = lambda z: 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def estimate(counts: list[dict]) -> tuple[list[float], dict[tuple[str, str], float]]:
    """Expectation-maximisation over counts of vote patterns (kind, a vote by each labeler, n): the chance that each is private, and reliabilities.

    For each kind, its share of private spans and how each labeler votes on private spans and on others, abstaining
    included, start from what is believed and follow the data; a labeler that says the same of everything counts for nothing.
    """
    belief = {x: {True: {1: OPINION * r, -1: OPINION * (1 - r), 0: 1 - OPINION}, False: {1: OPINION * (1 - r), -1: OPINION * r, 0: 1 - OPINION}} for x, r in LABELERS.items()}
    kinds = sorted({r["kind"] for r in counts})
    chance, share, posterior = {k: belief for k in kinds}, dict.fromkeys(kinds, 0.5), [0.5] * len(counts)
    for _ in range(EM_ROUNDS):
        posterior = [_sigmoid(_logit(share[r["kind"]]) + sum(math.log(c[True][r[x]] / c[False][r[x]]) for x, c in chance[r["kind"]].items())) for r in counts]
        for k in kinds:
            own = [(p, r) for p, r in zip(posterior, counts) if r["kind"] == k]
            share[k] = (sum(p * r["n"] for p, r in own) + 1) / (sum(r["n"] for _, r in own) + 2)
            chance[k] = {x: {} for x in LABELERS}
            for x in LABELERS:
                for private in (True, False):
                    seen = {v: BELIEF * belief[x][private][v] for v in (1, 0, -1)}
                    for p, r in own:
                        seen[r[x]] += r["n"] * (p if private else 1 - p)
                    chance[k][x][private] = {v: n / sum(seen.values()) for v, n in seen.items()}
    return posterior, {(k, x): round(c[True][1] / (c[True][1] + c[False][1]), 6) for k in kinds for x, c in chance[k].items()}


def _trained(patterns: list[dict]) -> dict[str, float]:
    """Logistic weights by feature for patterns of traits with n candidates, of which p are private by expectation.

    Kinds count alike, and a pattern by the root of its n, so that what is rare is learnt beside what is common.
    """
    names = [_features(r) for r in patterns]
    weights, held = dict.fromkeys((n for row in names for n in row), 0.0), {}
    for r in patterns:
        held[r["kind"]] = held.get(r["kind"], 0) + math.sqrt(r["n"])
    for _ in range(FIT_ROUNDS if patterns else 0):
        slope = dict.fromkeys(weights, 0.0)
        for row, r in zip(names, patterns):
            error = (_sigmoid(sum(weights[n] for n in row)) - r["p"] / r["n"]) * math.sqrt(r["n"]) / held[r["kind"]] / len(held)
            for n in row:
                slope[n] += error
        for n in weights:
            weights[n] -= 2.0 * (slope[n] + 1e-4 * weights[n])
    return {n: round(w, 6) for n, w in weights.items()}


def fit(spotted: DataFrame) -> SpanModel:
    """Fits the span classifier on all candidates (column `more` of spot()) of all documents, without labels.

    Only counts come to the driver, bounded whatever the corpus holds: candidates by kind and votes (five times 3^5 rows at
    most), from which estimate() has reliabilities and the chance that a candidate is private; then, with these chances added
    up, candidates by their traits (PATTERNS rows at most), which a logistic classifier is trained on.
    """
    c = F.col("c")
    seen = votes(c["kind"], c["value"], c["before"], c["after"])
    told = [v.alias(f"t_{k}") for k, v in traits(c).items()]
    counted = spotted.select(F.explode("more").alias("c")).select(*(v.alias(k) for k, v in seen.items()), *told)
    counted = cut(counted.groupBy(*counted.columns).agg(F.count("*").alias("n")))
    key = [F.col("t_kind").alias("kind"), *LABELERS]
    counts = [r.asDict() for r in counted.groupBy(*key).agg(F.sum("n").alias("n")).orderBy("kind", *LABELERS).collect()]
    if not counts:
        return SpanModel({}, {})
    posterior, reliability = estimate(counts)
    chances = spotted.sparkSession.createDataFrame([(r["kind"], *(r[x] for x in LABELERS), p) for r, p in zip(counts, posterior)], ", ".join(["t_kind string", *(f"{x} int" for x in LABELERS), "p double"]))
    names = [t for t in counted.columns if t.startswith("t_")]
    summed = counted.join(F.broadcast(chances), ["t_kind", *LABELERS]).groupBy(*names).agg(F.sum("n").alias("n"), F.sum(F.round(F.col("n") * F.col("p"), 9)).alias("p")).orderBy(*names)
    patterns = [{k.removeprefix("t_"): v for k, v in r.asDict().items()} for r in summed.collect()]
    return SpanModel(reliability, _trained(patterns))


def spot(docs: DataFrame, *, text_column: str = "text") -> DataFrame:
    """docs with base (arrays of kind, start, stop of the base patterns' valid matches) and more (the candidates, with what stands around them)."""
    keep = docs.columns
    rows = _matches(docs.withColumn("_text", F.coalesce(F.col(text_column), F.lit(""))), BASE | CANDIDATES)
    every = lambda kind, x: F.lit(True)
    base, more = (F.concat(*(_spans(k, _keeper(test, k)) for k in kinds)) for kinds, test in ((BASE, _valid), (CANDIDATES, every)))
    return rows.select(*keep, F.transform(base, _short).alias("base"), more.alias("more"))


def _short(c: Column) -> Column:
    return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop"))


def judged(spotted: DataFrame, model: SpanModel) -> DataFrame:
    """spotted with spans in place of more: base and the candidates that the classifier accepts, by kind as listed in BASE and CANDIDATES, then by start."""
    accepted = F.transform(F.filter("more", lambda c: model.log_odds(c) > 0), _short)
    return spotted.withColumn("spans", F.concat("base", accepted)).drop("more")


def annotate(docs: DataFrame, model: SpanModel, *, text_column: str = "text") -> DataFrame:
    """docs with base and spans (see judged()). A null text has none."""
    return judged(spot(docs, text_column=text_column), model)


def listed(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redacted(text: Column, spans: str) -> Column:
    """text with each span replaced by its kind in brackets; spans that overlap one replaced before are swallowed by it."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))

    def step(a: Column, s: Column) -> Column:
        inside = s["start"] < a["at"]
        put = F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(a["at"], s["stop"]).alias("at"), F.when(inside, a["out"]).otherwise(put).alias("out"))

    done = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redact(docs: DataFrame, *, text_column: str = "text") -> DataFrame:
    """docs with each personal span of its text replaced by its kind in brackets; other columns as they are, null stays null.

    Texts are searched once: they are written with what was found in them, as the classifier is fitted on all of it.
    """
    others = [c for c in docs.columns if c != text_column]
    rows = docs.select(F.col(text_column).alias("text"), F.struct(F.lit(0).alias("_"), *others).alias("others"))  # names can't clash in here
    spotted = cut(spot(rows))
    found = judged(spotted, fit(spotted))
    return found.select(*(redacted(F.col("text"), "spans").alias(c) if c == text_column else F.col("others")[c].alias(c) for c in docs.columns))


def find(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, base and spans of every row of docs (see judged()), with a classifier fitted on all of docs.

    Row by row, without a shuffle of text: texts are searched once, and what is found is written, not the texts. A null or
    empty text has no spans; repeated rows and null ids stay as they are; other columns are not read. Without any candidate
    only the base patterns count.
    """
    spotted = cut(spot(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))).select("id", "base", "more"))
    return judged(spotted, fit(spotted)).select(F.col("id").alias(id_column), "base", "spans")
