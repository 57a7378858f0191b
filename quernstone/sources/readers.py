"""Readers of source formats: text tables, flat files, markup and archives, as DataFrames.

Files that must be read in order (records over lines, markup, archives) are read whole by one task each,
``binaryFile`` to ``mapInArrow``; line formats stay with Spark's own readers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A headerless table with a fixed schema; a row that doesn't fit fails the job."""
    return spark.read.schema(schema).option("sep", "\t").option("mode", "FAILFAST").option("quote", "").csv(path)


def headed_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A table whose header must be exactly ``columns``; all values are strings."""
    df = spark.read.option("sep", "\t").option("quote", "").option("header", True).csv(path)
    if df.columns != columns:
        raise ValueError(f"{path} has the columns {df.columns}, not {columns}")
    return df


#: The columns of the public 42-column molecular interaction format, in its order.
MITAB_COLUMNS = (
    "id_a", "id_b", "alt_ids_a", "alt_ids_b", "aliases_a", "aliases_b", "methods", "authors", "publications", "taxids_a", "taxids_b",
    "types", "databases", "interaction_ids", "confidences", "expansions", "biological_roles_a", "biological_roles_b",
    "experimental_roles_a", "experimental_roles_b", "molecule_types_a", "molecule_types_b", "xrefs_a", "xrefs_b", "xrefs",
    "annotations_a", "annotations_b", "annotations", "host_taxids", "parameters", "created", "updated", "checksums_a", "checksums_b",
    "checksums", "negative", "features_a", "features_b", "stoichiometries_a", "stoichiometries_b", "identifications_a", "identifications_b",
)


def mitab(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a 42-column interaction table: every field as a list of its items, with what is derived from them.

    line_sha256 is the digest of the line; accession_a and accession_b are the first UniProt accessions among ids and alternatives;
    negative is null where the field is empty. ids_a and ids_b are the lists of the first two fields. A row of another width or
    with an unknown negative flag fails the job.
    """
    line = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    f = F.split("value", "\t", -1)
    checked = F.when(F.size(f) == len(MITAB_COLUMNS), f).otherwise(F.raise_error(F.concat(F.lit("a row of "), F.size(f).cast("string"), F.lit(" fields"))).cast("array<string>"))
    df = line.select(F.sha2("value", 256).alias("line_sha256"), checked.alias("f"))
    lists = {n: X.pipe_list(F.get("f", F.lit(i))) for i, n in enumerate(MITAB_COLUMNS) if n not in ("id_a", "id_b", "negative")}
    flag = F.lower(F.trim(F.get("f", F.lit(MITAB_COLUMNS.index("negative")))))
    negative = F.when(flag.isin("true", "yes", "1"), True).when(flag.isin("false", "no", "0"), False).when(flag.isin("", "-"), F.lit(None))
    negative = negative.otherwise(F.raise_error(F.concat(F.lit("unknown negative flag "), flag)).cast("boolean"))
    df = df.select("line_sha256", X.pipe_list(F.get("f", F.lit(0))).alias("ids_a"), X.pipe_list(F.get("f", F.lit(1))).alias("ids_b"), *[c.alias(n) for n, c in lists.items()], negative.alias("negative"))
    known = lambda side: F.get(F.filter(F.transform(F.concat(f"ids_{side}", f"alt_ids_{side}"), lambda x: F.regexp_extract(x, r"(?i)^uniprotkb:\s*([^( ]+)", 1)), lambda x: x != ""), F.lit(0))
    return df.withColumns({"accession_a": known("a"), "accession_b": known("b")})


def mitab_participants(rows: DataFrame) -> DataFrame:
    """Two rows for each row of ``mitab``: side, accession, ids, taxid, roles, molecule and identification terms, stoichiometry."""

    def side(x):
        first = lambda n: X.term(F.get(F.col(f"{n}_{x}"), F.lit(0)))
        (role_ac, role), (experimental_ac, experimental), (molecule_ac, molecule) = first("biological_roles"), first("experimental_roles"), first("molecule_types")
        taxid = F.regexp_extract(F.get(F.col(f"taxids_{x}"), F.lit(0)), r"^taxid:(-?\d+)", 1).try_cast("int")
        return F.struct(
            F.lit(x).alias("side"), F.col(f"accession_{x}").alias("accession"), F.concat(f"ids_{x}", f"alt_ids_{x}").alias("ids"), F.col(f"aliases_{x}").alias("aliases"), taxid.alias("taxid"),
            role_ac.alias("biological_role_ac"), role.alias("biological_role"), experimental_ac.alias("experimental_role_ac"), experimental.alias("experimental_role"),
            molecule_ac.alias("molecule_type_ac"), molecule.alias("molecule_type"), F.transform(f"identifications_{x}", lambda t: X.term(t)[1]).alias("identifications"), F.col(f"stoichiometries_{x}").alias("stoichiometries"),
        )

    return rows.select("line_sha256", F.inline(F.array(side("a"), side("b"))))


def mitab_features(rows: DataFrame) -> DataFrame:
    """A row for each feature of each participant: its kind, its text after the colon and its bounds (null where they are no numbers)."""

    def sided(x):
        return F.transform(f"features_{x}", lambda t: F.struct(F.lit(x).alias("side"), t.alias("feature")))

    feature = F.explode(F.concat(sided("a"), sided("b"))).alias("p")
    text = F.regexp_replace("feature", r"\([^)]*\)$", "")
    start, end = X.feature_range(text)
    return rows.select("line_sha256", feature).select("line_sha256", "p.side", "p.feature").withColumns({"kind": F.split_part("feature", F.lit(":"), F.lit(1)), "start": start, "end": end, "interval_state": X.interval_state(start, end)})


def commented_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A (gzip) table with a comment line and a header line before its rows."""
    df = spark.read.option("sep", "\t").option("comment", "#").option("header", True).option("quote", "").csv(path)
    return df.select(*columns)


#: The columns of the public tables of chains of structures.
CHAIN_COLUMNS = ["PDB", "CHAIN", "SP_PRIMARY", "RES_BEG", "RES_END", "PDB_BEG", "PDB_END", "SP_BEG", "SP_END"]
TAXONOMY_COLUMNS = ["PDB", "CHAIN", "TAX_ID", "SCIENTIFIC_NAME"]


def chain_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments of chains on accessions, mapped or observed: structure, chain, accession, numeric bounds on both and the interval's state.

    Bounds in the numbering of the structure's authors stay text; None and empty bounds are null.
    """
    df = commented_tsv(spark, path, CHAIN_COLUMNS)
    n = lambda c: X.safe_number(F.nullif(F.col(c), F.lit("None")), "int")
    df = df.select(F.lower("PDB").alias("structure"), F.col("CHAIN").alias("chain"), F.col("SP_PRIMARY").alias("accession"), n("RES_BEG").alias("residue_start"), n("RES_END").alias("residue_end"),
                   F.col("PDB_BEG").alias("author_start"), F.col("PDB_END").alias("author_end"), n("SP_BEG").alias("start"), n("SP_END").alias("end"))
    return df.withColumn("interval_state", X.interval_state(F.col("start"), F.col("end")))


def chain_taxa(spark: SparkSession, path: str) -> DataFrame:
    """Taxa of chains: structure, chain, the distinct taxids in order and whether there are several."""
    df = commented_tsv(spark, path, TAXONOMY_COLUMNS)
    taxa = df.groupBy(F.lower("PDB").alias("structure"), F.col("CHAIN").alias("chain")).agg(F.array_sort(F.collect_set(F.col("TAX_ID").try_cast("int"))).alias("taxids"))
    return taxa.withColumn("chimeric", F.size("taxids") > 1)


def pair_list(spark: SparkSession, path: str) -> DataFrame:
    """A two-column pair list in file order: a, b, self_pair, occurrence (from 0) of the unordered pair."""
    from ..operators.reconcile import numbered

    rows = spark.read.schema("x string, y string").option("sep", "\t").csv(path).withColumn("at", F.monotonically_increasing_id())
    rows = rows.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (F.col("x") == F.col("y")).alias("self_pair"), "at")
    return numbered(rows, ["a", "b"], "at").drop("at")


#: The sets of non-interacting pairs, with their kind of evidence and parent set, and the header of the structural ones.
NEGATIVE_SETS = {
    "manual": ("manual_experimental_negative", "manual"),
    "manual_stringent": ("manual_experimental_negative", "manual"),
    "pdb": ("structure_derived_noncontact", "pdb"),
    "pdb_stringent": ("structure_derived_noncontact", "pdb"),
}
NEGATIVE_HEADER = "#ProteinA\tProteinB\tPDB_Code\tevidence"


def negative_pairs(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Rows of a four-field table of non-interacting pairs, numbered within their file; a row of another form fails the job.

    The third field is a PubMed or PMC number in the manual sets; in the structural ones, which begin with a header, it is a list
    of structures. Files are small and read whole, one by a task, as the numbers follow their lines.
    """
    if dataset not in NEGATIVE_SETS:
        raise ValueError(f"unknown set {dataset}")
    family, parent = NEGATIVE_SETS[dataset]
    headed = parent == "pdb"
    bad = lambda text: F.raise_error(F.concat(F.lit(f"{dataset} row "), F.col("ordinal").cast("string"), F.lit(f": {text}")))
    lines = F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")
    if headed:
        lines = F.when(F.get(lines, F.lit(0)) == NEGATIVE_HEADER, F.slice(lines, 2, F.size(lines))).otherwise(F.raise_error(F.lit(f"{dataset}: another header")).cast("array<string>"))
    rows = spark.read.text(path, wholetext=True).where("value <> ''").select(F.posexplode(lines).alias("at", "line")).select((F.col("at") + 1).alias("ordinal"), F.split("line", "\t", -1).alias("f"))
    whole = (F.size("f") == 4) & ~F.exists("f", lambda x: x == "")
    rows = rows.select("ordinal", F.when(whole, F.col("f")).otherwise(bad("needs four fields").cast("array<string>")).alias("f"))
    a, b, third, assay = (F.get("f", F.lit(i)) for i in range(4))
    none = F.array().cast("array<string>")
    if headed:
        ids = F.filter(F.transform(F.split(third, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")
        publications, structures = none, F.when(F.size(ids) > 0, ids).otherwise(bad("names no structure").cast("array<string>"))
    else:
        known = F.when(third.rlike("^[0-9]+$"), F.concat(F.lit("pubmed:"), third)).when(third.rlike("^PMC[0-9]+$"), F.concat(F.lit("pmc:"), third))
        publications, structures = F.array(F.coalesce(known, bad("names no publication").cast("string"))), none
    term = F.nullif(F.regexp_extract(F.trim(assay), r"^(MI:\d{4})\s*(?:-|\s)", 1), F.lit(""))
    return rows.select(
        F.lit(dataset).alias("dataset"), F.lit(family).alias("evidence_family"), F.lit(parent).alias("parent_dataset"), "ordinal", a.alias("accession_a"), b.alias("accession_b"), third.alias("field_3"),
        assay.alias("assay_text"), publications.alias("publication_ids"), structures.alias("pdb_ids"), term.alias("assay_mi_ac"), F.concat(F.lit("line:"), F.col("ordinal") + int(headed)).alias("raw_locator"),
    )


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """header and sequence of each record; records split at a line that begins with >."""
    record = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^>|\n$", "").alias("v"))
    parts = F.split("v", "\n", 2)
    return record.where(F.col("v") != "").select(F.get(parts, F.lit(0)).alias("header"), F.translate(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), "\n\r ", "").alias("sequence"))


def fasta_fields(df: DataFrame) -> DataFrame:
    """Accession, taxid, gene and sequence version from a protein database header."""
    take = lambda p: F.nullif(F.regexp_extract("header", p, 1), F.lit(""))
    return df.withColumns({"accession": take(r"^\w+\|([^|]+)\|"), "taxid": take(r"OX=(\d+)").cast("long"), "gene": take(r"GN=(\S+)"), "sequence_version": take(r"SV=(\d+)").cast("int")})


def flat_file(spark: SparkSession, path: str) -> DataFrame:
    """Records of a line-coded flat file, each ended by //: names, accessions, versions, taxid, declared and real length.

    gene_names holds the names alone, all_gene_names also synonyms, ordered loci and reading frames; protein_names the full names; isoforms the ids of
    alternative products; xrefs (database, id) of every cross reference. Evidence tags in braces go.
    """
    record = spark.read.option("lineSep", "\n//\n").text(path).where(F.col("value").rlike(r"(?m)^ID "))
    lines = lambda code: F.regexp_extract_all("value", F.lit(rf"(?m)^{code}   (.*)$"), F.lit(1))
    plain = lambda x: F.regexp_replace(x, r"\s*\{[^}]*\}", "")
    found = lambda x, pattern: F.regexp_extract_all(x, F.lit(pattern), F.lit(1))
    listed = lambda x: F.array_distinct(F.filter(F.transform(x, lambda i: F.trim(i)), lambda i: i != ""))
    split = lambda x: F.flatten(F.transform(x, lambda i: F.split(i, ",")))
    sequence = F.translate(F.regexp_extract("value", r"(?s)\nSQ [^\n]*\n(.*)$", 1), " \n/", "")
    products = F.array_join(F.filter(lines("CC"), lambda x: x.contains("IsoId=")), " ")
    refs = F.transform(lines("DR"), lambda x: F.struct(F.trim(F.split_part(x, F.lit(";"), F.lit(1))).alias("database"), F.regexp_replace(F.trim(F.split_part(x, F.lit(";"), F.lit(2))), r"\.$", "").alias("id")))
    out = record.select(
        F.nullif(F.regexp_extract("value", r"(?m)^ID   (\S+)", 1), F.lit("")).alias("entry_name"), F.col("value").rlike(r"(?m)^ID .*\bReviewed;").alias("reviewed"),
        listed(F.split(F.array_join(lines("AC"), ""), ";")).alias("accessions"),
        F.regexp_extract_all(F.array_join(lines("GN"), " "), F.lit(r"Name=([^;{ ]+)"), F.lit(1)).alias("gene_names"),
        listed(split(found(plain(F.array_join(lines("GN"), " ")), r"(?:Name|Synonyms|OrderedLocusNames|ORFNames)=([^;]*)"))).alias("all_gene_names"),
        listed(found(plain(F.array_join(lines("DE"), " ")), r"Full=([^;]*)")).alias("protein_names"),
        F.regexp_extract(F.array_join(lines("OX"), " "), r"NCBI_TaxID=(\d+)", 1).try_cast("long").alias("taxid"), listed(split(found(products, r"IsoId=([^;]*)"))).alias("isoforms"), refs.alias("xrefs"),
        F.regexp_extract("value", r"entry version (\d+)", 1).try_cast("int").alias("entry_version"), F.regexp_extract("value", r"sequence version (\d+)", 1).try_cast("int").alias("sequence_version"),
        F.regexp_extract("value", r"(?m)^ID .*?(\d+) AA", 1).try_cast("int").alias("declared"), sequence.alias("sequence"),
    )
    return out.withColumn("length_agrees", F.length("sequence") == F.col("declared"))


def flat_file_problems(records: DataFrame) -> DataFrame:
    """Records that the format forbids: without accession, with another length than declared, or with a first accession met before."""
    first = records.select(F.get("accessions", F.lit(0)).alias("accession"), "entry_name", "length_agrees")
    twice = first.where("accession is not null").groupBy("accession").agg(F.count("*").alias("n")).where("n > 1").select("accession", F.lit("repeated").alias("problem"))
    single = F.when(F.col("accession").isNull(), "no accession").when(~F.coalesce("length_agrees", F.lit(False)), "length")
    return first.select(F.coalesce("accession", "entry_name").alias("accession"), single.alias("problem")).where("problem is not null").union(twice)


def obo(spark: SparkSession, path: str) -> DataFrame:
    """Stanzas of an ontology: kind, id, name, and every is_a and synonym as lists."""
    stanza = spark.read.option("lineSep", "\n\n").text(path).where(F.trim("value").startswith("["))
    all_of = lambda k: F.regexp_extract_all("value", F.lit(rf"(?m)^{k}: ([^\n]*)"), F.lit(1))
    return stanza.select(F.regexp_extract("value", r"\[(\w+)\]", 1).alias("kind"), F.get(all_of("id"), F.lit(0)).alias("id"), F.get(all_of("name"), F.lit(0)).alias("name"), F.transform(all_of("is_a"), lambda x: F.trim(F.split(x, "!")[0])).alias("is_a"), all_of("synonym").alias("synonyms"))


def broken_rows(spark: SparkSession, path: str, fields: int) -> DataFrame:
    """Logical rows of a table whose fields hold line ends: lines are joined until a row has all its fields."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows, held = [], ""
                for line in content.decode().split("\n"):
                    held = f"{held}\n{line}" if held else line
                    n = held.count("\t") + 1
                    if n > fields:
                        raise ValueError(f"{name}: a row of {n} fields")
                    if n == fields:
                        rows.append(held.split("\t"))
                        held = ""
                yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.string()))], names=["ordinal", "fields"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, "ordinal long, fields array<string>")


def safe_member(name: str) -> bool:
    """Whether an archive member's name stays inside the archive."""
    return bool(name) and not name.startswith(("/", "\\")) and "\0" not in name and ".." not in name.replace("\\", "/").split("/")


def archive_members(spark: SparkSession, path: str, wanted: str | None = None) -> DataFrame:
    """Members of ZIP and TAR.GZ archives: archive, member, size, sha256, and the payload of those that match ``wanted``.

    Members are read in pieces and hashed on the way; only wanted ones are held whole. Unsafe, repeated and linked members fail
    the job.
    """

    def members(name, content):
        import io
        import tarfile
        import zipfile

        if zipfile.is_zipfile(io.BytesIO(content)):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for i in z.infolist():
                    if not i.is_dir():
                        yield i.filename, z.open(i)
        else:
            with tarfile.open(fileobj=io.BytesIO(content), mode="r|*") as t:
                for m in t:
                    if m.issym() or m.islnk():
                        raise ValueError(f"{name}: {m.name} is a link")
                    if m.isfile():
                        yield m.name, t.extractfile(m)

    def work(batches):
        import hashlib
        import re

        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                seen = set()
                for member, stream in members(name, content):
                    if not safe_member(member) or member in seen:
                        raise ValueError(f"{name}: the member {member!r} is unsafe or repeated")
                    seen.add(member)
                    digest, size, kept = hashlib.sha256(), 0, [] if wanted and re.search(wanted, member) else None
                    while piece := stream.read(2**20):
                        digest.update(piece)
                        size += len(piece)
                        if kept is not None:
                            kept.append(piece)
                    payload = None if kept is None else b"".join(kept)
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([member]), pa.array([size], pa.int64()), pa.array([digest.hexdigest()]), pa.array([payload], pa.binary())], names=["archive", "member", "size", "sha256", "payload"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, "archive string, member string, size long, sha256 string, payload binary")


def payload_rows(members: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of the tab-separated payloads of ``archive_members``: archive, member, ordinal from 1 and ``columns``, the exact header."""
    lines = F.split(F.regexp_replace(F.decode("payload", "UTF-8"), r"\r?\n$", ""), r"\r?\n")
    header = F.get(lines, F.lit(0))
    checked = F.when(header == "\t".join(columns), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(F.raise_error(F.concat("member", F.lit(": another header"))).cast("array<string>"))
    rows = members.where("payload is not null").select("archive", "member", F.posexplode(checked).alias("at", "line")).where("line <> ''")
    f = F.split("line", "\t", -1)
    whole = F.when(F.size(f) == len(columns), f).otherwise(F.raise_error(F.concat("member", F.lit(": a row of another width"))).cast("array<string>"))
    rows = rows.select("archive", "member", (F.col("at") + 1).alias("ordinal"), whole.alias("f"))
    return rows.select("archive", "member", "ordinal", *[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(columns)])


def value_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """How often each value stands in each of the columns: field, value, n."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.inline(pairs)).groupBy("field", "value").agg(F.count("*").alias("n"))


def payload_fasta(members: DataFrame) -> DataFrame:
    """archive, member, header and sequence of each record of the FASTA payloads of ``archive_members``."""
    records = F.filter(F.split(F.concat(F.lit("\n"), F.decode("payload", "UTF-8")), "\n>"), lambda x: F.trim(x) != "")
    parts = F.split("v", "\n", 2)
    rows = members.where("payload is not null").select("archive", "member", F.explode(records).alias("v"))
    return rows.select("archive", "member", F.trim(F.translate(F.get(parts, F.lit(0)), "\r", "")).alias("header"), F.translate(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), "\n\r ", "").alias("sequence"))


TERM = "struct<ac: string, name: string>"
RANGE = "struct<start: int, end: int, start_status: string, end_status: string>"
FEATURE = f"struct<id: string, label: string, type: {TERM}, ranges: array<{RANGE}>>"
INTERACTOR = f"struct<id: string, label: string, primary_db: string, primary_id: string, xrefs: array<string>, taxid: int, organism: string, type: {TERM}, sequence_sha256: string>"
PARTICIPANT = f"struct<id: string, interactor_id: string, interactor: {INTERACTOR}, biological_role: {TERM}, experimental_roles: array<{TERM}>, identifications: array<{TERM}>, expressed_in: int, features: array<{FEATURE}>>"
EXPERIMENT = f"struct<id: string, label: string, detection: {TERM}, identification: {TERM}, publications: array<string>, host_taxids: array<int>>"
RECORD = (
    f"interaction_id string, label string, xrefs array<string>, type {TERM}, expansion {TERM}, negative boolean, modelled boolean, confidences array<string>, "
    f"participants array<{PARTICIPANT}>, experiment_ordinal int, experiment {EXPERIMENT}"
)


def _nodes(node, *tags):
    """The children by a path of tags, namespaces aside."""
    found = [] if node is None else [node]
    for tag in tags:
        found = [c for n in found for c in n if c.tag.rpartition("}")[2] == tag]
    return found


def _said(node, *tags):
    return next((n.text.strip() for n in _nodes(node, *tags) if n.text and n.text.strip()), None)


def _refs(node):
    return [r for tag in ("primaryRef", "secondaryRef") for r in _nodes(node, "xref", tag)]


def _named(node):
    """Accession and name of a vocabulary term."""
    if node is None:
        return None
    ac = next((r.get("id") for r in _refs(node) if (r.get("id") or "").startswith("MI:")), None)
    return {"ac": ac, "name": _said(node, "names", "shortLabel") or _said(node, "names", "fullName")}


def _first(node, *tags):
    return next(iter(_nodes(node, *tags)), None)


def _whole(text):
    digits = (text or "").removeprefix("-")
    return int(text) if digits.isascii() and digits.isdigit() else None


def _taxid(node):
    return None if node is None else _whole(node.get("ncbiTaxId"))


def _xrefs(node):
    return [f"{(r.get('db') or '').lower()}:{r.get('id')}" for r in _refs(node) if r.get("id")]


def _interactor(node):
    import hashlib

    primary, sequence, organism = _first(node, "xref", "primaryRef"), _said(node, "sequence"), _first(node, "organism")
    return {
        "id": node.get("id"), "label": _said(node, "names", "shortLabel"), "primary_db": None if primary is None else primary.get("db"), "primary_id": None if primary is None else primary.get("id"),
        "xrefs": _xrefs(node), "taxid": _taxid(organism), "organism": _said(organism, "names", "shortLabel"), "type": _named(_first(node, "interactorType")),
        "sequence_sha256": hashlib.sha256(sequence.encode()).hexdigest() if sequence else None,
    }


def _experiment(node):
    hosts = [_taxid(h) for h in _nodes(node, "hostOrganismList", "hostOrganism")]
    return {
        "id": node.get("id"), "label": _said(node, "names", "shortLabel"), "detection": _named(_first(node, "interactionDetectionMethod")), "identification": _named(_first(node, "participantIdentificationMethod")),
        "publications": list(dict.fromkeys(_xrefs(_first(node, "bibref")) + _xrefs(node))), "host_taxids": [h for h in hosts if h is not None],
    }


def _bound(node, side):
    """A position, or the outer end of an interval of positions."""
    at = _first(node, side)
    if at is not None and (p := _whole(at.get("position"))) is not None:
        return p
    inside = [p for n in _nodes(node, f"{side}Interval") for c in n if (p := _whole(c.get("position"))) is not None]
    return None if not inside else min(inside) if side == "begin" else max(inside)


def _feature(node):
    status = lambda r, tag: (_named(_first(r, tag)) or {}).get("name")
    ranges = [{"start": _bound(r, "begin"), "end": _bound(r, "end"), "start_status": status(r, "startStatus"), "end_status": status(r, "endStatus")} for r in _nodes(node, "featureRangeList", "featureRange")]
    return {"id": node.get("id"), "label": _said(node, "names", "shortLabel"), "type": _named(_first(node, "featureType")), "ranges": ranges}


def _participant(node, people):
    own = _first(node, "interactor")
    ref = _said(node, "interactorRef") or (None if own is None else own.get("id"))
    return {
        "id": node.get("id"), "interactor_id": ref, "interactor": people.get(ref), "biological_role": _named(_first(node, "biologicalRole")),
        "experimental_roles": [_named(r) for r in _nodes(node, "experimentalRoleList", "experimentalRole")],
        "identifications": [_named(r) for r in _nodes(node, "participantIdentificationMethodList", "participantIdentificationMethod")],
        "expressed_in": _taxid(_first(node, "expressedInOrganism")), "features": [_feature(f) for f in _nodes(node, "featureList", "feature")],
    }


def _interaction(node, people):
    flag = lambda tag: None if (t := _said(node, tag)) is None else t.lower() == "true"
    unit = lambda c: _named(_first(c, "unit")) or {}
    return {
        "interaction_id": node.get("id"), "label": _said(node, "names", "shortLabel"), "xrefs": _xrefs(node), "type": _named(_first(node, "interactionType")), "expansion": _named(_first(node, "expansionMethod")),
        "negative": flag("negative"), "modelled": flag("modelled"),
        "confidences": [f"{unit(c).get('ac') or unit(c).get('name') or 'unspecified'}:{_said(c, 'value') or ''}" for c in _nodes(node, "confidenceList", "confidence")],
        "participants": [_participant(p, people) for p in _nodes(node, "participantList", "participant")],
    }


def interaction_rows(stream):
    """The records of one XML stream, one for each interaction and experiment; an interaction's nodes go when its rows are made."""
    import xml.etree.ElementTree as E

    people, experiments = {}, {}
    for event, node in E.iterparse(stream, events=("start", "end")):
        kind = node.tag.rpartition("}")[2]
        if event == "start":
            if kind == "entry":
                people, experiments = {}, {}
        elif kind == "interactor":
            people[node.get("id")] = _interactor(node)
        elif kind == "experimentDescription":
            experiments[node.get("id")] = _experiment(node)
        elif kind == "interaction":
            refs = [n.get("id") or (n.text or "").strip() for n in (c for x in _nodes(node, "experimentList") for c in x)]
            for k, ref in enumerate(refs or [None]):
                known = experiments.get(ref) or (ref and {"id": ref})
                yield _interaction(node, people) | {"experiment_ordinal": k + 1 if refs else None, "experiment": known or None}
            node.clear()


def interaction_records(spark: SparkSession, path: str) -> DataFrame:
    """Interactions of molecular interaction XML, bare or as members of ZIP archives, one row for each experiment.

    Interactors and experiments are resolved within their entry; one that isn't there is null, an experiment then keeps its id.
    Interactions without an experiment have one row. Files are parsed as streams: an interaction's nodes go when its rows are made.
    """

    def streams(content):
        import io
        import zipfile

        if not zipfile.is_zipfile(io.BytesIO(content)):
            yield io.BytesIO(content)
            return
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for i in z.infolist():
                if not safe_member(i.filename):
                    raise ValueError(f"the member {i.filename!r} is unsafe")
                if i.filename.lower().endswith(".xml"):
                    with z.open(i) as stream:
                        yield stream

    def work(batches):
        from itertools import batched

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for batch in batches:
            for content in batch.column("content"):
                for stream in streams(content.as_py()):
                    for some in batched(interaction_rows(stream), 1000):
                        yield pa.RecordBatch.from_pylist(list(some), schema=kinds)

    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(RECORD)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(work, schema)


def interactions_xml(spark: SparkSession, path: str) -> DataFrame:
    """The short form of ``interaction_records``: interaction_id, label of the experiment, labels of the participants, negative."""
    label = lambda p: F.coalesce(p["interactor"]["label"], p["interactor_id"])
    return interaction_records(spark, path).select("interaction_id", F.coalesce("experiment.label", "experiment.id").alias("experiment"), F.transform("participants", label).alias("participants"), F.coalesce("negative", F.lit(False)).alias("negative"))
