"""Personal data: patterns propose spans, checksums confirm them, context words adjust a score.

Every kind has a pattern, a validator over the matched text, a starting score and context words. Spans
are positions in code points. The positions come from cutting the text at the matches: the lengths of
the pieces between matches and of the matches themselves, summed, give every start.

Patterns are written so that Java's matcher neither recurses nor scans a run again for each of
its characters (possessive runs, and a start that is not inside a run unless the previous match ended there),
with the same matches as the plain form given in the comment.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import table

#: Code points before and after a span in which context words count.
WINDOW = 48


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def digit_values(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: c.cast("int"))


def luhn(text: Column) -> Column:
    """13 to 19 digits whose Luhn sum is a multiple of ten."""
    ds = F.reverse(digit_values(digits(text)))
    parts = F.transform(ds, lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d)))
    total = F.aggregate(parts, F.lit(0), lambda a, x: a + x)
    return F.length(digits(text)).between(13, 19) & (total % 10 == 0)


def octets(text: Column) -> Column:
    """Four numbers of at most 255 (leading zeros do not count)."""
    return F.forall(
        F.split(text, "\\."),
        lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3)
        & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).cast("int"), F.lit(0)) <= 255),
    )


def mod97(text: Column) -> Column:
    """IBAN check: country and check digits moved to the end, letters as 10 to 35, remainder 1 modulo 97."""
    bare = F.upper(F.replace(text, F.lit(" "), F.lit("")))
    turned = F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))
    values = F.transform(
        F.filter(F.split(turned, ""), lambda c: c != ""),
        lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55),
    )
    rest = F.aggregate(values, F.lit(0), lambda a, v: (F.when(v > 9, a * 100 + v).otherwise(a * 10 + v) % 97).cast("int"))
    return F.length(bare).between(15, 34) & (rest == 1)


@dataclass(frozen=True)
class Kind:
    """A kind of personal data. ``hint`` is a cheap necessary condition on the text, ``least`` the code points of its shortest match."""

    name: str
    pattern: str
    valid: Callable[[Column], Column]
    score: float
    context: str
    hint: Callable[[Column], Column]
    least: int


_LOCAL = "[A-Za-z0-9._%+-]"
#: The four base kinds of the contract, in its order.
BASE = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind(
        "email",
        rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda m: F.lit(True),
        0.9,
        "mail|contact|write|kontakt|correo|courriel",
        lambda t: F.contains(t, F.lit("@")),
        5,
    ),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Kind(
        "ip",
        r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        octets,
        0.6,
        "ip|address|host|server|adresse|servidor",
        lambda t: t.rlike(r"[0-9]\.[0-9]"),
        7,
    ),
    # [0-9]([\x20-]?[0-9])+
    Kind(
        "card",
        r"[0-9]++(?:[\x20-][0-9]++)*+",
        luhn,
        0.7,
        "card|visa|credit|karte|tarjeta|carte",
        lambda t: t.rlike("[0-9]"),
        1,
    ),
    # \+[0-9][\x20().0-9-]+[0-9]
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        lambda m: F.length(digits(m)).between(9, 15),
        0.7,
        "call|phone|tel|mobile|fon|llame|fax",
        lambda t: F.contains(t, F.lit("+")),
        4,
    ),
)
#: Kinds the method adds: account numbers by mod 97.
EXTRA = (
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
        mod97,
        0.8,
        "iban|bank|account|konto|cuenta|compte",
        lambda t: t.rlike("[A-Z]{2}[0-9]{2}"),
        12,
    ),
)
SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def sums_before(sizes: Column) -> Column:
    """For every element of an array of numbers (a bound value, not empty) the sum of those before it.

    Two levels: the sums of blocks of about the square root of the length, and within a block.
    """
    zero, n = F.lit(0), F.size(sizes)
    total = lambda part: F.aggregate(part, zero, lambda a, x: a + x)
    block = F.ceil(F.sqrt(n)).cast("int")
    blocks = lambda b: F.sequence(zero, F.ceil(n / b).cast("int") - 1)

    def with_block(b: Column) -> Column:
        totals = F.transform(blocks(b), lambda k: total(F.slice(sizes, k * b + 1, b)))
        before = let(totals, lambda t: F.transform(blocks(b), lambda k: total(F.slice(t, F.lit(1), k))))
        place = lambda i: (i - i % b + 1, (i / b).cast("int"), i % b)  # noqa: E731  first of its block, block, place in it
        inside = lambda i: total(F.slice(sizes, place(i)[0], place(i)[2]))
        return let(before, lambda base: F.transform(sizes, lambda _, i: base[place(i)[1]] + inside(i)))

    return let(block, with_block)


def find(text: Column, kind: Kind) -> Column:
    """Valid spans of one kind, ordered; matches that fail the validator are dropped, with no second try.

    Positions are sums over the pieces before a match and context comes from the pieces around it, so a text with very many matches
    takes little more than one with few.
    """
    gaps, hits = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))

    def matched(m: Column) -> Column:
        sizes = F.transform(m["hits"], lambda h, i: F.length(m["gaps"][i]) + F.length(h))
        start = let(sizes, sums_before)
        spots = let(start, lambda s: F.transform(m["hits"], lambda h, i: F.struct(i.alias("at"), (s[i] + F.length(m["gaps"][i])).alias("start"))))
        valid = F.filter(spots, lambda x: kind.valid(m["hits"][x["at"]]))
        pieces = F.struct(
            m["hits"].alias("hits"),
            F.transform(m["gaps"], lambda g: F.right(g, F.lit(WINDOW))).alias("tails"),
            F.transform(m["gaps"], lambda g: F.left(g, F.lit(WINDOW))).alias("heads"),
        )
        return F.when(F.size(m["hits"]) > 0, let(pieces, lambda p: F.transform(valid, lambda x: scored(p, x))))

    def scored(p: Column, x: Column) -> Column:
        # this many matches on either side reach over the window
        many = -(-WINDOW // kind.least)
        first = F.greatest(x["at"] - many, F.lit(0))
        left = F.concat(
            F.array_join(F.transform(F.slice(p["hits"], first + 1, x["at"] - first), lambda h, i: F.concat(p["tails"][first + i], h)), ""),
            p["tails"][x["at"]],
        )
        after = F.transform(F.slice(p["hits"], x["at"] + 2, F.lit(many)), lambda h, i: F.concat(h, p["heads"][x["at"] + 2 + i]))
        right = F.concat(p["heads"][x["at"] + 1], F.array_join(after, ""))
        near = F.lower(F.concat_ws(" ", F.right(left, F.lit(WINDOW)), F.left(right, F.lit(WINDOW)))).rlike(f"\\b(?:{kind.context})")
        score = F.when(near, kind.score + (1 - kind.score) / 2).otherwise(kind.score)
        end = x["start"] + F.length(p["hits"][x["at"]])
        return F.struct(F.lit(kind.name).alias("kind"), x["start"].alias("start"), end.alias("end"), score.alias("score"))

    none = F.array().cast(SPAN)
    found = let(F.struct(gaps.alias("gaps"), hits.alias("hits")), matched)
    return F.coalesce(F.when(kind.hint(text), found), none).cast(SPAN)


def pii_spans(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = BASE + EXTRA) -> DataFrame:
    """Add one column of spans per kind, ``pii_<kind>``: array of (kind, start, end, score).

    Null text is empty and has no spans. Each row is handled on its own: repeated rows and ties give
    equal results, an empty table stays empty, other columns pass through (a column named like one of
    the new ones is replaced).
    """
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({f"pii_{k.name}": find(t, k) for k in kinds})


def render(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = BASE + EXTRA, least: float = 0.5) -> DataFrame:
    """Replace every span scored at least ``least`` by ``[KIND]``; of overlapping spans the one that starts first wins."""
    found = pii_spans(docs, text, kinds)
    t = F.coalesce(F.col(text), F.lit(""))
    spans = F.array_sort(
        F.filter(F.concat(*[F.col(f"pii_{k.name}") for k in kinds]), lambda s: s["score"] >= least),
        lambda a, b: F.coalesce(F.nullif(a["start"] - b["start"], F.lit(0)), b["end"] - a["end"]),
    )

    def step(a: Column, s: Column) -> Column:
        add = F.concat(F.substring(t, a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        new = F.struct(s["end"].alias("at"), F.concat(a["out"], add).alias("out"))
        return F.when(s["start"] >= a["at"], new).otherwise(a)

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    tail = F.concat(done["out"], F.substring(t, done["at"] + 1, F.length(t)))
    return found.withColumn(text, F.when(F.col(text).isNotNull(), tail)).drop(*[f"pii_{k.name}" for k in kinds])


def op8_pii_score(spark, sf_dir):
    found = pii_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.concat(*[F.col(f"pii_{k.name}") for k in BASE])
    every = F.concat(*[F.col(f"pii_{k.name}") for k in BASE + EXTRA])
    return found.select(
        "doc_id",
        *[F.size(f"pii_{k.name}").cast("long").alias(f"n_{k.name}") for k in BASE],
        F.sha2(F.encode(render(base), "UTF-8"), 256).alias("base_sha256"),
        render(every).alias("spans"),
        F.array_join(F.transform(every, lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )
