"""The formats, round trips and contracts."""

import gzip
import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from quernstone.operators.contracts import Contract, ContractError, Ledger, leaking_keys, violations
from quernstone.sources import readers, sinks


def put(tmp_path, name, data):
    p = tmp_path / name
    p.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(p)


def test_typed_tsv_is_strict(spark, tmp_path):
    path = put(tmp_path, "a.tsv", "x\t1\ny\t2\n")
    assert [tuple(r) for r in readers.tsv(spark, path, "a string, n int").collect()] == [("x", 1), ("y", 2)]
    with pytest.raises(Exception):
        readers.tsv(spark, put(tmp_path, "b.tsv", "x\n"), "a string, n int").collect()
    with pytest.raises(ValueError):
        readers.headed_tsv(spark, put(tmp_path, "c.tsv", "a\tb\n1\t2\n"), ["a", "c"])


def test_mitab_and_commented(spark, tmp_path):
    fields = ["-"] * 42
    fields[0], fields[1], fields[9], fields[35] = "uniprotkb:P1|ensembl:E1", "uniprotkb:P2", "taxid:9606(human)", "true"
    r = readers.mitab(spark, put(tmp_path, "m.txt", "#head\n" + "\t".join(fields) + "\n")).first()
    assert (r.ids_a, r.ids_b, r.methods, r.negative) == (["uniprotkb:P1", "ensembl:E1"], ["uniprotkb:P2"], [], True)
    path = put(tmp_path, "s.tsv.gz", gzip.compress(b"# note\nPDB\tCHAIN\n1abc\tA\n"))
    assert [tuple(x) for x in readers.commented_tsv(spark, path, ["PDB", "CHAIN"]).collect()] == [("1abc", "A")]


def test_fasta_and_flat_file(spark, tmp_path):
    path = put(tmp_path, "x.fasta", ">sp|P1|N OS=x OX=9606 GN=G1 PE=1 SV=2\nMA\nAA\n>sp|P2|M\nMK\n")
    rows = readers.fasta_fields(readers.fasta(spark, path)).orderBy("accession").collect()
    assert [(r.accession, r.sequence, r.taxid, r.gene, r.sequence_version) for r in rows] == [("P1", "MAAA", 9606, "G1", 2), ("P2", "MK", None, None, None)]
    dat = "ID   T   Reviewed;   4 AA.\nAC   P1; P2;\nDT   01-JAN-2000, sequence version 2.\nDT   01-JAN-2000, entry version 7.\nGN   Name=TEST1; Synonyms=X;\nSQ   SEQUENCE   4 AA;\n     MAAA\n//\n"
    r = readers.flat_file(spark, put(tmp_path, "x.dat", dat)).first()
    assert (r.accessions, r.gene_names, r.entry_version, r.sequence_version, r.sequence, r.length_agrees) == (["P1", "P2"], ["TEST1"], 7, 2, "MAAA", True)


def test_obo_and_broken_rows(spark, tmp_path):
    obo = "format-version: 1\n\n[Term]\nid: MI:1\nname: root\n\n[Term]\nid: MI:2\nname: leaf\nis_a: MI:1 ! root\nsynonym: \"l\" EXACT []\n"
    rows = readers.obo(spark, put(tmp_path, "x.obo", obo)).orderBy("id").collect()
    assert [(r.id, r.name, r.is_a) for r in rows] == [("MI:1", "root", []), ("MI:2", "leaf", ["MI:1"])]
    got = readers.broken_rows(spark, put(tmp_path, "b.tsv", "a\tb1\nb2\tc\nx\ty\tz"), 3).collect()
    assert [r.fields for r in got] == [["a", "b1\nb2", "c"], ["x", "y", "z"]]


def test_archives(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("d/a.txt", "one")
        z.writestr("b.bin", "two")
    path = put(tmp_path, "x.zip", buffer.getvalue())
    rows = {r.member: r for r in readers.archive_members(spark, path, r"\.txt$").collect()}
    assert rows["d/a.txt"].payload == b"one" and rows["b.bin"].payload is None and rows["b.bin"].size == 3
    tar = sinks.deterministic_tar({"b": b"2", "a": b"1"})
    assert tar == sinks.deterministic_tar({"a": b"1", "b": b"2"}) and tarfile.open(fileobj=io.BytesIO(tar)).getnames() == ["a", "b"]
    assert [r.member for r in readers.archive_members(spark, put(tmp_path, "x.tar.gz", gzip.compress(tar))).collect()] == ["a", "b"]
    assert not readers.safe_member("../x") and not readers.safe_member("/x") and readers.safe_member("a/b")


def test_interaction_xml(spark, tmp_path):
    xml = """<entrySet xmlns="x"><entry><experimentList><experimentDescription id="e1"><names><shortLabel>exp</shortLabel></names></experimentDescription></experimentList>
    <interactorList><interactor id="1"><names><shortLabel>A</shortLabel></names></interactor><interactor id="2"><names><shortLabel>B</shortLabel></names></interactor></interactorList>
    <interactionList><interaction id="9"><experimentList><experimentRef>e1</experimentRef></experimentList><participantList><participant id="p"><interactorRef>1</interactorRef></participant><participant id="q"><interactorRef>2</interactorRef></participant></participantList><negative>true</negative></interaction></interactionList></entry></entrySet>"""
    r = readers.interactions_xml(spark, put(tmp_path, "x.xml", xml)).collect()
    assert [tuple(x) for x in r] == [("9", "exp", ["A", "B"], True)]


def test_mitab_in_full(spark, tmp_path):
    fields = ["-"] * 42
    put_in = {0: "intact:E1", 2: "uniprotkb:P1(x)|uniprotkb:P2", 1: "uniprotkb:Q9", 9: "taxid:-2(chemical)", 10: "taxid:9606(human)", 16: 'psi-mi:"MI:0499"(unspecified role)', 18: 'psi-mi:"MI:0496"(bait)', 14: "score:0.5|rank:2", 36: "binding region:4-8(text)|tag:?-?", 35: "-", 38: "2", 40: 'psi-mi:"MI:0396"(predetermined)'}
    for i, v in put_in.items():
        fields[i] = v
    rows = readers.mitab(spark, put(tmp_path, "full.txt", "\t".join(fields) + "\n"))
    r = rows.first()
    assert len(rows.columns) == 45 and (r.accession_a, r.accession_b, r.negative, r.confidences, r.types) == ("P1", "Q9", None, ["score:0.5", "rank:2"], [])
    a, b = readers.mitab_participants(rows).orderBy("side").collect()
    assert (a.accession, a.taxid, a.biological_role_ac, a.experimental_role, a.identifications, a.stoichiometries) == ("P1", -2, "MI:0499", "bait", ["predetermined"], ["2"])
    assert (b.accession, b.taxid, b.biological_role, b.ids) == ("Q9", 9606, None, ["uniprotkb:Q9"])
    found = {f.kind: (f.side, f.start, f.end, f.interval_state) for f in readers.mitab_features(rows).collect()}
    assert found == {"binding region": ("a", 4, 8, "ascending"), "tag": ("a", None, None, "incomplete")}
    for i, v in ((35, "maybe"), (41, "x\ty")):
        with pytest.raises(Exception):
            readers.mitab(spark, put(tmp_path, f"bad{i}.txt", "\t".join([*fields[:i], v, *fields[i + 1 :]]) + "\n")).collect()


def test_chain_tables(spark, tmp_path):
    head = "# 2026/01/01\n" + "\t".join(readers.CHAIN_COLUMNS) + "\n"
    path = put(tmp_path, "c.tsv.gz", gzip.compress((head + "1ABC\tA\tP1\t1\t9\tNone\t12A\t5\t13\n1abc\tB\tP2\t1\t2\t1\t2\t\t4\n").encode()))
    rows = readers.chain_segments(spark, path).orderBy("chain").collect()
    assert [(r.structure, r.accession, r.author_end, r.start, r.end, r.interval_state) for r in rows] == [("1abc", "P1", "12A", 5, 13, "ascending"), ("1abc", "P2", "2", None, 4, "incomplete")]
    path = put(tmp_path, "t.tsv", "#x\n" + "\t".join(readers.TAXONOMY_COLUMNS) + "\n1abc\tA\t9606\tman\n1ABC\tA\t562\tcoli\n1abc\tB\t9606\tman\n1abc\tB\t9606\tman\n")
    assert [tuple(r) for r in readers.chain_taxa(spark, path).orderBy("chain").collect()] == [("1abc", "A", [562, 9606], True), ("1abc", "B", [9606], False)]


def test_flat_file_in_full(spark, tmp_path):
    record = """ID   NAME_HUMAN   Reviewed;   4 AA.
AC   X1; X2;
DE   RecName: Full=First name {ECO:1};
DE   AltName: Full=Other;
GN   Name=GA {ECO:2}; Synonyms=GB, GC;
GN   ORFNames=GA, o1;
OX   NCBI_TaxID=9606 {ECO:3};
CC       IsoId=X1-1; Sequence=Displayed;
CC       IsoId=X1-2, X9-4; Sequence=VSP_1;
DR   Ensembl; ENST1; ENSP1; ENSG1.
DR   GeneID; 17.
SQ   SEQUENCE   4 AA;
     MA AA
//
ID   SHORT   Unreviewed;   5 AA.
AC   X1;
SQ   SEQUENCE   5 AA;
     MAAA
//
"""
    rows = readers.flat_file(spark, put(tmp_path, "x.dat", record))
    r = rows.where("reviewed").first()
    assert (r.entry_name, r.all_gene_names, r.protein_names, r.taxid, r.isoforms) == ("NAME_HUMAN", ["GA", "GB", "GC", "o1"], ["First name", "Other"], 9606, ["X1-1", "X1-2", "X9-4"])
    assert [tuple(x) for x in r.xrefs] == [("Ensembl", "ENST1"), ("GeneID", "17")] and r.length_agrees
    assert {tuple(x) for x in readers.flat_file_problems(rows).collect()} == {("X1", "length"), ("X1", "repeated")}


def test_archive_payloads(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("t.tsv", "a\tb\n1\tx\n2\tx\n")
        z.writestr("s.fasta", ">h 1\r\nMA\nAA\n>h2\nM\n")
    path = put(tmp_path, "p.zip", buffer.getvalue())
    rows = readers.payload_rows(readers.archive_members(spark, path, r"\.tsv$"), ["a", "b"])
    assert [(r.ordinal, r.a, r.b) for r in rows.orderBy("ordinal").collect()] == [(1, "1", "x"), (2, "2", "x")]
    assert {tuple(r) for r in readers.value_counts(rows, ["a", "b"]).collect()} == {("a", "1", 1), ("a", "2", 1), ("b", "x", 2)}
    with pytest.raises(Exception):
        readers.payload_rows(readers.archive_members(spark, path, r"\.tsv$"), ["a", "c"]).collect()
    assert [(r.header, r.sequence) for r in readers.payload_fasta(readers.archive_members(spark, path, "fasta")).orderBy("header").collect()] == [("h 1", "MAAA"), ("h2", "M")]


def test_interaction_records(spark, tmp_path):
    term = lambda tag, ac, name: f'<{tag}><names><shortLabel>{name}</shortLabel></names><xref><primaryRef db="psi-mi" id="{ac}"/></xref></{tag}>'
    interactor = '<interactor id="1"><names><shortLabel>A</shortLabel></names><xref><primaryRef db="uniprotkb" id="P1"/><secondaryRef db="RefSeq" id="N1"/></xref><organism ncbiTaxId="9606"><names><shortLabel>human</shortLabel></names></organism><sequence>MA</sequence></interactor>'
    feature = f'<feature id="f1">{term("featureType", "MI:0117", "region")}<featureRangeList><featureRange><begin position="3"/><endInterval begin="1"><x position="8"/><x position="11"/></endInterval></featureRange></featureRangeList></feature>'
    xml = f"""<entrySet xmlns="x"><entry>
    <experimentList><experimentDescription id="e1"><names><shortLabel>exp</shortLabel></names><bibref><xref><primaryRef db="PubMed" id="7"/></xref></bibref><hostOrganismList><hostOrganism ncbiTaxId="4932"/></hostOrganismList>{term("interactionDetectionMethod", "MI:0018", "two hybrid")}</experimentDescription></experimentList>
    <interactorList>{interactor}</interactorList><interactionList><interaction id="9"><xref><primaryRef db="intact" id="EBI-1"/></xref><experimentList><experimentRef>e1</experimentRef><experimentRef>e2</experimentRef></experimentList>
    <participantList><participant id="p"><interactorRef>1</interactorRef>{term("biologicalRole", "MI:0499", "none")}<experimentalRoleList>{term("experimentalRole", "MI:0496", "bait")}</experimentalRoleList><featureList>{feature}</featureList></participant>
    <participant id="q"><interactor id="2"><names><shortLabel>B</shortLabel></names></interactor></participant></participantList>{term("interactionType", "MI:0915", "physical association")}
    <confidenceList><confidence><unit><names><shortLabel>score</shortLabel></names></unit><value>0.5</value></confidence></confidenceList></interaction></interactionList></entry>
    <entry><interactionList><interaction id="10"><participantList><participant id="z"><interactorRef>1</interactorRef></participant></participantList></interaction></interactionList></entry></entrySet>"""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("d/x.xml", xml)
        z.writestr("readme.txt", "no")
    rows = readers.interaction_records(spark, put(tmp_path, "x.zip", buffer.getvalue())).orderBy("interaction_id", "experiment_ordinal").collect()
    assert [(r.interaction_id, r.experiment_ordinal) for r in rows] == [("10", None), ("9", 1), ("9", 2)]
    other, r, unknown = rows
    assert other.participants[0].interactor is None and other.participants[0].interactor_id == "1" and other.experiment is None and other.negative is None
    assert (unknown.experiment.id, unknown.experiment.label) == ("e2", None)
    assert (r.experiment.publications, r.experiment.host_taxids, tuple(r.experiment.detection)) == (["pubmed:7"], [4932], ("MI:0018", "two hybrid"))
    p, q = r.participants
    assert (p.interactor.primary_id, p.interactor.xrefs, p.interactor.taxid, p.interactor.organism) == ("P1", ["uniprotkb:P1", "refseq:N1"], 9606, "human")
    assert (tuple(p.biological_role), [x.name for x in p.experimental_roles], p.features[0].type.ac, p.features[0].ranges[0].start, p.features[0].ranges[0].end) == (("MI:0499", "none"), ["bait"], "MI:0117", 3, 11)
    assert q.interactor.label == "B" and r.confidences == ["score:0.5"] and r.type.ac == "MI:0915" and r.xrefs == ["intact:EBI-1"]


def test_contracts(spark, tmp_path):
    c = Contract("t", {"k": "int64", "v": "string"}, required=("v",), vocabularies={"v": ("a",)}, key=("k",))
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "k long, v string")
    assert {(r.check, r.violations) for r in violations(df, c).collect()} == {("required", 1), ("vocabulary", 1), ("primary_key", 1)}
    with pytest.raises(ContractError):
        sinks.publish(df, str(tmp_path / "bad"), c)
    assert not (tmp_path / "bad").exists()
    with pytest.raises(ContractError):
        Contract("t", {"k": "map"})
    with pytest.raises(ContractError):
        c.conform(df.withColumn("z", F.lit(1)))
    good = df.limit(1)
    sinks.publish(good, str(tmp_path / "good"), c, order=["k"])
    assert sinks.manifest(spark, str(tmp_path / "good"))["rows"] == 1
    with pytest.raises(FileExistsError):
        sinks.publish(good, str(tmp_path / "good"), c)
    assert leaking_keys({"a": [{"pair_id": 1}]}) == ["$.a[0].pair_id"]
    assert sinks.replaced_prefix({"p": "/x/y", "q": ["/xz"]}, "/x", "/n") == {"p": "/n/y", "q": ["/xz"]}
    ledger = Ledger()
    ledger.check("one", True)
    ledger.check("two", False, warning=True)
    assert ledger.verdict() == "warning"


def test_negative_pairs(spark, tmp_path):
    manual = put(tmp_path, "m.txt", "A1\tB1\t123\tMI:0019 - coip\nA2\tB2\tPMC77\tother\n")
    rows = readers.negative_pairs(spark, manual, "manual").orderBy("ordinal").collect()
    assert [(r.ordinal, r.accession_a, r.publication_ids, r.pdb_ids, r.assay_mi_ac, r.raw_locator) for r in rows] == [(1, "A1", ["pubmed:123"], [], "MI:0019", "line:1"), (2, "A2", ["pmc:PMC77"], [], None, "line:2")]
    structural = put(tmp_path, "p.txt", "#ProteinA\tProteinB\tPDB_Code\tevidence\nA\tB\t1ABC, 2xyz,\tseen\n")
    r = readers.negative_pairs(spark, structural, "pdb_stringent").first()
    assert (r.evidence_family, r.parent_dataset, r.pdb_ids, r.publication_ids, r.raw_locator) == ("structure_derived_noncontact", "pdb", ["1abc", "2xyz"], [], "line:2")
    assert readers.negative_pairs(spark, put(tmp_path, "e.txt", ""), "manual").collect() == []
    for name, text, kind in (("x", "A\tB\t12\n", "manual"), ("y", "A\tB\tx9\ty\n", "manual"), ("z", "A\tB\t1abc\ty\n", "pdb")):
        with pytest.raises(Exception):
            readers.negative_pairs(spark, put(tmp_path, name, text), kind).collect()
    with pytest.raises(ValueError):
        readers.negative_pairs(spark, manual, "other")


def test_manifest_by_contents(spark, tmp_path):
    path, again = str(tmp_path / "t"), str(tmp_path / "u")
    df = spark.range(100).select("id", (F.col("id") % 7).alias("v"))
    for p in (path, again):
        sinks.publish(df, p, order=["id"], rows_per_part=30)
    one, two = sinks.manifest(spark, path), sinks.manifest(spark, again)
    assert one["rows"] == 100 and max(p[2] for p in one["parts"]) <= 30 and one["sha256"] == two["sha256"]
    assert sinks.manifest_differences(spark, path, one).collect() == []
    changed = one | {"parts": [["gone.parquet", 1, 1, "x"], [*one["parts"][0][:3], "x"], *one["parts"][2:]]}
    found = {r.file_name: r.problem for r in sinks.manifest_differences(spark, path, changed).collect()}
    assert found == {"gone.parquet": "missing", one["parts"][0][0]: "content", one["parts"][1][0]: "unlisted"}
    with pytest.raises(ValueError):
        sinks.manifest_differences(spark, path, one | {"parts": one["parts"] + one["parts"]})


def test_stream_equals_batch(spark, tmp_path):
    from quernstone.streaming.events import stream_of, windowed_counts

    rows = spark.sql("SELECT timestamp_seconds(1700000000 + id * 977) AS ts, if(id % 2 = 0, 'view', 'click') AS event_type, CAST(id AS DOUBLE) AS value FROM range(200)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(stream_of(spark, str(tmp_path / "in"), rows.schema))
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, windowed_counts(rows).collect()))
