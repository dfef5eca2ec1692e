"""Personal data in texts: patterns propose, checksums confirm, context words adjust the score.

Everything is column expressions. A kind's matches and the text between them come from one
pattern, so lengths alone give the positions, and the context of a match is the end of the piece
before it and the start of the piece after it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featlake.llm.common import whole_text

#: How much of the neighbouring text counts as context, in characters.
CONTEXT = 48
#: Added to the score of a span whose context has one of its kind's words.
BOOST = 0.3
#: Kinds beyond the base are kept from this score on.
ENOUGH = 0.7
_BLOCK = 256


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _values(text: Column) -> Column:
    """The characters of a text of digits and capital letters as numbers, A as 10 and so on."""
    return F.transform(
        F.split(text, ""), lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    )


def luhn(text: Column) -> Column:
    """Whether the digits of the text have a right Luhn check digit."""
    doubled = F.transform(
        F.split(F.reverse(_digits(text)), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            F.floor(c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10
        ),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether an account number in the international form has right check digits."""
    plain = F.upper(F.regexp_replace(text, "[ -]", ""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    rest = F.aggregate(
        _values(turned), F.lit(0), lambda a, x: F.when(x < 10, a * 10 + x).otherwise(a * 100 + x) % 97
    )
    return rest == 1


def _parts_in_range(text: Column) -> Column:
    part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return text.rlike(rf"^{part}\.{part}\.{part}\.{part}$")


@dataclass(frozen=True)
class Kind:
    """A kind of span. ``base`` kinds stay whatever their score; others need ``ENOUGH``."""

    name: str
    pattern: str
    score: float
    check: Callable[[Column], Column] | None = None
    words: str = ""
    base: bool = False
    #: A cheap test that texts with a match pass.
    hint: Callable[[Column], Column] | None = field(default=None)


_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"

#: The characters of an account number by country.
_ACCOUNT_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _account_numbers() -> str:
    """Account numbers in groups of four. A known country fixes the end, whatever words or numbers follow."""
    ways, known = [], []
    for length, countries in _ACCOUNT_LENGTHS.items():
        known += countries.split()
        groups, rest = divmod(length - 4, 4)
        tail = rf"\x20?[A-Z0-9]{{{rest}}}" if rest else ""
        ways.append(rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{groups}}}{tail}")
    ways.append(rf"(?!{'|'.join(known)})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}+(?:\x20?[A-Z0-9]{{1,3}})?+")
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(ways)})(?![A-Za-z0-9])"


#: The quantifiers are possessive and the starts are fixed where that cannot change a match, so
#: time stays in proportion to the text and no pattern needs a deep stack.
KINDS = (
    Kind(
        "email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++", 0.7, None,
        "e-?mail|mail|contact|write|kontakt|correo|courriel", True, lambda t: F.contains(t, F.lit("@")),
    ),
    Kind(
        "ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, _parts_in_range,
        "ip|address|host|server|login|adresse", True, lambda t: t.rlike(r"[0-9]\.[0-9]"),
    ),
    # Runs of digits with single separators are matched whole, and only those of 14 to 19 digits.
    Kind(
        "card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])", 0.7, luhn,
        "card|visa|master|credit|payment|karte|tarjeta|carte", True, lambda t: t.rlike("[0-9]"),
    ),
    Kind(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, lambda m: F.length(_digits(m)).between(10, 15),
        "phone|tel|call|mobile|fax|telefon|llame|appel", True, lambda t: F.contains(t, F.lit("+")),
    ),
    Kind(
        "iban", _account_numbers(), 0.8, mod97, "iban|account|bank|konto|cuenta|compte", False,
        lambda t: t.rlike("[A-Z]{2}[0-9]{2}"),
    ),
    # A social security number is nine digits in three groups; only its context tells it apart.
    Kind(
        "ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", 0.4, None,
        "ssn|social security|sozialversicherung|seguridad social", False, lambda t: t.rlike("[0-9]-[0-9]"),
    ),
    # A number without the plus sign is a telephone number only beside a word that says so. It is not the
    # end of a longer number with dots or dashes, nor of one with a plus sign.
    Kind(
        "phone_local",
        r"(?=[(0-9])(?<![0-9+])(?<![0-9][.-])(?<!\+[0-9\x20().-]{1,20})"
        r"(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])", 0.4,
        None, "phone|tel|call|mobile|fax|telefon|llame|appel", False, lambda t: t.rlike("[0-9][.-][0-9]"),
    ),
)
_SPAN = "struct<start:int,end:int,kind:int,score:double,text:string>"


def _running_sums(values: Column) -> Column:
    """The sums of all values up to each one. Blocks keep the copying of growing arrays in bounds."""
    add = lambda a, x: a + x
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")),
        lambda b: F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)),
    )
    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), add))

    def within(block: Column, nth: Column) -> Column:
        start = F.aggregate(F.slice(sums, F.lit(1), nth), F.lit(0), add)
        grown = F.aggregate(
            block, F.array(start),
            lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)),
        )
        return F.slice(grown, F.lit(2), F.lit(_BLOCK))

    return F.flatten(F.transform(blocks, within))


def _with_spans(df: DataFrame, text: str, nth: int, kind: Kind) -> DataFrame:
    """Add ``_pii_kind{nth}``: the kind's spans that pass its check, with their scores."""
    near = rf"(?i)(?<!\p{{L}})(?:{kind.words})(?!\p{{L}})"
    hit, pieces, ends, out = f"_pii_hit{nth}", f"_pii_pieces{nth}", f"_pii_ends{nth}", f"_pii_kind{nth}"
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    df = df.withColumn(hit, F.when(kind.hint(F.col(text)), matches))
    some = F.size(hit) > 0  # also false where there is no array
    df = df.withColumn(pieces, F.when(some, F.split(F.col(text), kind.pattern, -1)))
    lengths = F.zip_with(F.slice(pieces, F.lit(1), F.size(hit)), hit, lambda p, m: F.length(p) + F.length(m))
    df = df.withColumn(ends, F.when(some, _running_sums(lengths)))

    def span(m: Column, i: Column) -> Column:
        before, after = F.element_at(pieces, i + 1), F.element_at(pieces, i + 2)
        context = F.right(before, F.lit(CONTEXT)).rlike(near) | F.left(after, F.lit(CONTEXT)).rlike(near)
        score = F.lit(kind.score) + F.when(context, BOOST).otherwise(0.0)
        end = F.element_at(ends, i + 1)
        return F.struct(
            (end - F.length(m)).alias("start"), end.alias("end"), F.lit(nth).alias("kind"),
            score.alias("score"), m.alias("text"),
        )

    spans = F.transform(hit, span)
    if kind.check is not None:
        spans = F.filter(spans, lambda s: kind.check(s["text"]))
    if not kind.base:
        spans = F.filter(spans, lambda s: s["score"] >= ENOUGH)
    found = F.coalesce(F.when(some, spans), F.array().cast(f"array<{_SPAN}>"))
    return df.withColumn(out, found.cast(f"array<{_SPAN}>")).drop(hit, pieces, ends)


def find_personal_data(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with ``spans``: an array of ``start, end, kind, score, text`` by start, then kind.

    Positions are code points, the end is exclusive, and ``kind`` is a number in ``kinds``. Matches
    of a kind are leftmost and do not overlap; one that fails its check is dropped without another
    try. A null or empty text has no spans. A column of ``docs`` named ``spans`` is replaced.
    """
    df = docs.withColumn("_pii_text", whole_text(text_col))
    for nth, kind in enumerate(kinds):
        df = _with_spans(df, "_pii_text", nth, kind)
    names = [f"_pii_kind{nth}" for nth in range(len(kinds))]
    # Spans of two added kinds may be one thing; the base kinds never give way.
    return df.withColumn("spans", F.array_sort(F.concat(*names))).drop("_pii_text", *names)


def spelled(spans: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(k.name) for k in kinds])
    texts = F.transform(
        spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(texts, ",")


def base_spans(spans: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    base = [nth for nth, kind in enumerate(kinds) if kind.base]
    return F.filter(spans, lambda s: s["kind"].isin(base))


def redact(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in angle brackets.

    Where spans overlap, the one that starts first is replaced, up to its end, and the others lose
    what it covers. A null text stays null.
    """
    names = F.array(*[F.lit(f"<{k.name}>") for k in kinds])
    found = find_personal_data(docs.withColumn("_pii_whole", F.col(text_col)), "_pii_whole", kinds)
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        clear = s["start"] >= a["at"]
        gap = F.col("_pii_whole").substr(a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        out = F.when(clear, F.concat(a["out"], gap, F.element_at(names, s["kind"] + 1))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), out.alias("out"))

    tail = lambda a: F.concat(a["out"], F.col("_pii_whole").substr(a["at"] + 1, F.length("_pii_whole")))
    done = F.when(F.size("spans") == 0, F.col("_pii_whole")).otherwise(F.aggregate("spans", empty, step, tail))
    return found.withColumn(text_col, done).drop("_pii_whole", "spans")
