"""Scalar functions on source fields: identifiers, tokens, lists, intervals and sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def before_dot(x: Column) -> Column:
    return F.split_part(x, F.lit("."), F.lit(1))


def without_version(x: Column) -> Column:
    """A numeric version at the end goes, and nothing else."""
    return F.regexp_replace(x, r"\.\d+$", "")


def isoform_base(x: Column) -> Column:
    """The accession before the isoform alias -1, where x is one."""
    return F.when(x.endswith("-1"), F.substring(x, F.lit(1), F.length(x) - 2))


def accession_and_isoform(x: Column) -> tuple[Column, Column]:
    return F.regexp_extract(x, r"^([^-]+)", 1), F.nullif(F.regexp_extract(x, r"-(\d+)$", 1), F.lit(""))


def term(x: Column) -> tuple[Column, Column]:
    """Accession and name of a vocabulary term such as psi-mi:"MI:0397"(two hybrid array)."""
    pattern = r'(MI:\d+)"?\((.*)\)$'
    return F.nullif(F.regexp_extract(x, pattern, 1), F.lit("")), F.nullif(F.regexp_extract(x, pattern, 2), F.lit(""))


def pipe_list(x: Column) -> Column:
    """The non-empty items of a field with bars; a dash alone is empty."""
    return F.filter(F.transform(F.split(x, r"\|"), lambda i: F.trim(i)), lambda i: (i != "") & (i != "-"))


def feature_range(x: Column) -> tuple[Column, Column]:
    """Bounds of label:4-8; a bound that is no number is null."""
    pattern = r":([^:-]*)-([^:-]*)$"
    return F.regexp_extract(x, pattern, 1).try_cast("long"), F.regexp_extract(x, pattern, 2).try_cast("long")


def tri_state(x: Column, true=("1", "true", "yes", "y"), false=("0", "false", "no", "n")) -> Column:
    t = F.lower(F.trim(x))
    return F.when(t.isin(*true), True).when(t.isin(*false), False)


def optional_number(x: Column, kind: str = "double") -> Column:
    """Null for the tokens that mean nothing; any other text must be a number."""
    return F.when(x.isin("", "None", "-"), None).otherwise(x).cast(kind)


def safe_number(x: Column, kind: str = "double") -> Column:
    return F.nullif(x, F.lit("")).try_cast(kind)


def sorted_set(items: Column) -> Column:
    return F.array_sort(F.array_distinct(items))


def flags(*named: tuple[str, Column]) -> Column:
    """The names whose conditions hold, in their order."""
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in named]), lambda x: x.isNotNull())


def canonical_json(*fields: Column) -> Column:
    """An object of the columns in the order given, nulls kept."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def interval_state(start: Column, end: Column) -> Column:
    return F.when(start.isNull() | end.isNull(), "incomplete").when(start > end, "descending").otherwise("ascending")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def window_starts(length: Column, width: int, stride: int) -> Column:
    """Starts of windows over a sequence, the last one flush with its end."""
    return F.when(length <= width, F.array(F.lit(0))).otherwise(F.array_union(F.sequence(F.lit(0), length - width, F.lit(stride)), F.array(length - width)))


def segments(length: Column, target: int = 128, most: int = 32) -> Column:
    """Contiguous (start, end) pieces of nearly equal length: about target long, at most ``most`` of them."""
    n = F.greatest(F.lit(1), F.least(F.lit(most), F.ceil(length / target).cast("int")))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.floor(i * length / n).cast("int").alias("start"), F.floor((i + 1) * length / n).cast("int").alias("end")))


def ngrams(text: Column, n: int = 3) -> Column:
    size = F.length(text)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


#: The standard genetic code, codons in the order T, C, A, G of each base.
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def translate_cds(sequence: Column) -> Column:
    """The protein of a coding sequence without its final stop; a broken length, codon or inner stop raises."""
    bases = "TCAG"
    codons = F.create_map(*[F.lit(x) for i, aa in enumerate(AMINO_ACIDS) for x in (bases[i // 16] + bases[i // 4 % 4] + bases[i % 4], aa)])
    s = F.upper(sequence)
    known = F.when(F.length(s) % 3 != 0, F.raise_error("a coding sequence has a length that is no multiple of three").cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.floor(F.length(s) / 3).cast("int") - 1), lambda i: F.coalesce(F.element_at(codons, F.substring(s, i * 3 + 1, F.lit(3))), F.raise_error("unknown codon").cast("string")))
    )
    protein = F.regexp_replace(F.array_join(known, ""), r"\*$", "")
    return F.when(F.contains(protein, F.lit("*")), F.raise_error("a stop inside a coding sequence").cast("string")).otherwise(protein)


def reported_outcome(score: Column, confirmed_positive: Column, confirmed_negative: Column) -> Column:
    """The outcome that a raw score and the sequence confirmations for a positive and for a negative call are reported as; other tokens fail."""

    def token(x):
        t = F.trim(x)
        return F.when(t.isin("", "nan", "NaN", "NULL", "None"), F.lit(None)).otherwise(t)

    def confirmed(x):
        t = token(x)
        known = F.when(t.isin("1", "1.0", "True", "true"), True).when(t.isNull() | t.isin("0", "0.0", "False", "false"), False)
        return known.otherwise(F.raise_error(F.concat(F.lit("unexpected confirmation: "), x)).cast("boolean"))

    s, failed = token(score), F.lit("Failed sequence confirmation")
    out = F.when(s == "AA", "Autoactivator").when(s.isNull(), "Test failed")
    out = out.when(s.isin("0", "0.0"), F.when(confirmed(confirmed_negative), "Negative").otherwise(failed)).when(s.isin("1", "1.0"), F.when(confirmed(confirmed_positive), "Positive").otherwise(failed))
    return out.otherwise(F.raise_error(F.concat(F.lit("unexpected score: "), score)).cast("string"))
