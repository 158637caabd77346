"""Personal data: regular expressions propose spans, checksums confirm them, nearby context words adjust the score.

All patterns use possessive quantifiers and look-behinds that allow only the starts a leftmost search could take, so
a text of any length is read in one pass without back-tracking, with the matches of the plain patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import let

#: The contract's base kinds, in its order.
BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds that the method adds, after the base kinds.
ADDED_KINDS = ("iban", "ssn", "local_phone")
KINDS = BASE_KINDS + ADDED_KINDS

#: The length of an account number by country, as published in the registry of such numbers.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """Country, check digits, and as many characters as the country has, in groups of four with or without spaces."""
    rest = lambda n: r"(?:\x20?[A-Z0-9]{4}){%d}" % (n // 4) + (r"\x20?[A-Z0-9]{%d}" % (n % 4) if n % 4 else "")
    of_length = "|".join(f"(?:{names.replace(' ', '|')})[0-9]{{2}}{rest(n - 4)}" for n, names in IBAN_LENGTHS.items())
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}}\x20?[A-Z0-9]{{4}})(?:{of_length})(?![A-Za-z0-9])"


#: Kind -> (text that a match always contains, pattern).
PATTERNS = {
    "email": ("@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (".", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": (None, r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "iban": (None, _iban_pattern()),
    "ssn": ("-", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "local_phone": (None, r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"),
}
#: Kind -> (score of a span that passed its checks, what context words add, the words in English, French, German and
#: Spanish); spans need MIN_SCORE.
SCORES = {
    "email": (0.9, 0.1, "mail|contact|address|courriel|adresse|kontakt|correo|direcci|contacto"),
    "ip": (0.7, 0.2, "ip|server|host|address|serveur|adresse|servidor|direcci"),
    "card": (0.8, 0.2, "card|visa|credit|payment|account|carte|paiement|compte|karte|kredit|zahlung|konto|tarjeta|pago|cuenta"),
    "phone": (0.8, 0.2, "phone|tel|call|mobile|fax|t\u00e9l|appel|portable|anruf|mobil|handy|llam|m\u00f3vil"),
    "iban": (0.8, 0.2, "iban|bank|account|transfer|banque|compte|virement|konto|\u00fcberweisung|banco|cuenta|transferencia"),
    "ssn": (0.3, 0.5, "ssn|social security|tax|s\u00e9curit\u00e9 sociale|sozialversicherung|steuer|seguridad social|seguro social"),
    "local_phone": (0.3, 0.4, "phone|tel|call|mobile|fax|t\u00e9l|appel|portable|anruf|mobil|handy|llam|m\u00f3vil"),
}
MIN_SCORE = 0.5
#: Code points before and after a span in which context words count.
CONTEXT = 40


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _mod97(v: Column) -> Column:
    """Whether an account number passes: the country and check digits go last, letters count 10 to 35, the rest is 1."""
    compact = F.replace(v, F.lit(" "))
    turned = F.concat(F.substr(compact, F.lit(5)), F.left(compact, F.lit(4)))
    step = lambda acc, c: F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c))) == 1


def _passes(kind: str, v: Column) -> Column:
    if kind == "ip":
        part = lambda p: let(F.ltrim(p, F.lit("0")), lambda x: (F.length(x) <= 2) | ((F.length(x) == 3) & (x <= "255")))
        return F.forall(F.split(v, r"\."), part)
    if kind == "card":
        return let(_digits(v), lambda d: F.length(d).between(12, 19) & F.call_function("luhn_check", d))
    if kind == "phone":
        return F.length(_digits(v)).between(9, 15)
    if kind == "iban":
        return _mod97(v)
    if kind == "ssn":
        return ~F.left(v, F.lit(3)).isin("000", "666") & ~v.rlike("-00-|-0000$")
    return F.lit(True)


_SPAN = "array<struct<start:int,ord:int,end:int,kind:string,score:double>>"


def _spans(t: Column, kind: str) -> Column:
    """Confirmed spans of one kind, by position: gaps and matches of the pattern alternate, so lengths add up to offsets."""
    sure, pattern = PATTERNS[kind]
    base, more, near = SCORES[kind]

    def located(m: Column) -> Column:
        gaps = F.split(t, pattern, -1)
        zipped = F.zip_with(m, gaps, lambda v, g: F.struct(v.alias("v"), F.length(g).alias("g"), F.coalesce(F.length(v), F.lit(0)).alias("n")))
        walked = F.aggregate(
            zipped,
            F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<v:string,start:int,end:int>>)").alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + x["g"] + x["n"]).alias("at"),
                F.when(x["v"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(x["v"].alias("v"), (acc["at"] + x["g"]).alias("start"), (acc["at"] + x["g"] + x["n"]).alias("end"))))).alias("out"),
            ),
        )["out"]
        around = lambda x: F.lower(F.substring(t, F.greatest(x["start"] - CONTEXT, F.lit(0)) + 1, x["end"] - F.greatest(x["start"] - CONTEXT, F.lit(0)) + CONTEXT))
        score = lambda x: F.lit(base) + F.when(around(x).rlike(rf"\b(?:{near})"), F.lit(more)).otherwise(F.lit(0.0))
        scored = F.transform(F.filter(walked, lambda x: _passes(kind, x["v"])), lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("ord"), x["end"].alias("end"), F.lit(kind).alias("kind"), score(x).alias("score")))
        return scored if kind in BASE_KINDS else F.filter(scored, lambda x: x["score"] >= MIN_SCORE)

    none = F.expr(f"cast(array() as {_SPAN})")
    found = let(F.regexp_extract_all(t, F.lit(pattern), 0), lambda m: F.when(F.size(m) == 0, none).otherwise(located(m).cast(_SPAN)))
    return F.when(F.contains(t, F.lit(sure)), found).otherwise(none) if sure else found


def find_spans(text: Column) -> Column:
    """array<struct<start, ord, end, kind, score>> of a whole text by start, then kind; null and empty texts give none.

    Added spans that overlap a base span give way to it; those of one start stand in the order of KINDS.
    """

    def together(base: Column, t: Column) -> Column:
        added = F.concat(*[_spans(t, k) for k in ADDED_KINDS])
        free = F.filter(added, lambda a: ~F.exists(base, lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])))
        return F.array_sort(F.concat(base, free))

    return let(F.coalesce(text, F.lit("")), lambda t: let(F.concat(*[_spans(t, k) for k in BASE_KINDS]), lambda b: together(b, t)))


def render(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with a column pii_spans; rows stay as they are. A column of that name is replaced."""
    return docs.withColumn("pii_spans", find_spans(F.col("text")))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in square brackets and n_chars counted anew.

    Overlapping spans are replaced together, under the first one's kind. Null texts stay null; other columns stay.
    """

    def cut(spans: Column, t: Column) -> Column:
        step = lambda acc, x: F.when(x["start"] < acc["at"], F.struct(acc["out"].alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))).otherwise(
            F.struct(F.concat(acc["out"], F.substring(t, acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("out"), x["end"].alias("at"))
        )
        done = F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step)
        return let(done, lambda d: F.concat(d["out"], F.substr(t, d["at"] + 1)))

    text = let(find_spans(F.col("text")), lambda s: F.when(F.size(s) == 0, F.col("text")).otherwise(cut(s, F.col("text"))))
    changed = docs.withColumn("text", F.when(F.col("text").isNotNull(), text))
    return changed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else changed


def pii_report(docs: DataFrame) -> DataFrame:
    """The digest of each row's spans: doc_id, base counts, base_sha256, spans, top_score (the highest; null without spans).

    Null and empty texts have no spans; rows repeat as they do in ``docs``; other columns, whatever their names, are
    ignored and an empty table gives no rows.
    """
    found = docs.select("doc_id", find_spans(F.col("text")).alias("s"))
    base = F.filter("s", lambda x: x["ord"] < len(BASE_KINDS))
    count = lambda k: F.size(F.filter("s", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(render(base), 256).alias("base_sha256"), render(F.col("s")).alias("spans"), F.array_max(F.transform("s", lambda x: x["score"])).alias("top_score"))
