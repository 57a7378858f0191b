"""The sequence loader: each disagreement of FASTA and flat files, and the relation when there is none."""

import pytest

from quernstone.sources import readers, sequences as S


def put(path, name, text):
    (path / name).write_text(text)
    return str(path / name)


def flat(*records):
    return "".join(f"ID   {name}   Reviewed;   {len(seq)} AA.\nAC   {accession};\nDE   RecName: Full=Of {accession};\nOX   NCBI_TaxID=9606;\nGN   Name=GA; Synonyms=GB;\nDT   X, entry version 7.\nSQ   SEQUENCE\n     {seq}\n//\n" for accession, name, seq in records)


def staged(spark, path, canonical, additional, records):
    f = lambda name, text: S.stated(readers.fasta(spark, put(path, name, text)))
    return f("c.fasta", canonical), f("a.fasta", additional), S.flat_entries(readers.flat_file(spark, put(path, "x.dat", flat(*records))))


def test_each_fault(spark, tmp_path):
    canonical = ">sp|OK1|N A OS=x\nMA\nAA\n>sp|GONE1|N A\nMA\n>sp|OTHER1|N A\nMA\n>sp|TWICE1|N A\nMA\n>sp|TWICE1|N A\nMA\n>no fields\nMA\n>sp|NONE1|N A\n\n>sp|DOUBLE1|N A\nMA\n"
    additional = ">tr|I1|N Isoform of OK1-2, A\nMC\n>tr|I2|N Isoform of LOST1, A\nMC\n>tr|OK1|N A\nMC\n>tr|E1|N A\nMC\n"
    records = [("OK1", "N", "MAAA"), ("OTHER1", "N", "MV"), ("TWICE1", "N", "MA"), ("NONE1", "N", ""), ("MORE1", "N", "MK"), ("DOUBLE1", "N", "MA"), ("DOUBLE1", "N", "MC")]
    c, a, f = staged(spark, tmp_path, canonical, additional, records)
    faults = S.sequence_faults(c, a, f)
    assert sorted((r.sequence_id or "", r.fault) for r in faults.collect()) == sorted(
        [("GONE1", "absent_from_flat_file"), ("OTHER1", "sequence_mismatch"), ("TWICE1", "repeated_id"), ("OK1", "repeated_id"), ("MORE1", "absent_from_canonical"), ("DOUBLE1", "repeated_record"),
         ("DOUBLE1", "sequence_mismatch"), ("I2", "missing_parent"), ("", "malformed_header"), ("NONE1", "empty_sequence")])
    assert {r.fault: (r.n, r.first_id, r.last_id) for r in S.fault_census(faults).collect()}["repeated_id"] == (2, "OK1", "TWICE1")
    with pytest.raises(ValueError, match="2 repeated_id .OK1 to TWICE1."):
        S.loaded_sequences(c, a, f)


def test_loaded_relation(spark, tmp_path):
    canonical = ">sp|P1|N1 First one OS=Homo sapiens OX=1 GN=HLA A PE=1 SV=3\nMA\nAA\n"
    additional = ">tr|I1|M1 Isoform of P1-2, First OS=x OX=9606 GN=GA PE=1\nMC\n>tr|I2|M2 Isoform of P9, Lost OS=x\nMD\n>tr|A1|M3 Other OS=x OX=9606 SV=2\nME\n"
    c, a, f = staged(spark, tmp_path, canonical, additional, [("P1", "N1", "MAAA"), ("P2", "N2", "MK")])
    rows = {r.sequence_id: r for r in S.loaded_sequences(c, a, f).collect()}
    pick = lambda r: (r.uniprot_accession, r.isoform_id, r.sequence_view, r.canonical, r.reviewed, r.taxid, r.gene_names, r.protein_names, r.sequence_version, r.entry_version, r.sequence_length)
    assert pick(rows["P1"]) == ("P1", None, "canonical", True, True, 9606, ["GA", "GB"], ["Of P1"], 3, 7, 4)
    assert pick(rows["I1"]) == ("P1", "I1", "additional_isoform", False, False, 9606, ["GA"], ["Isoform of P1-2, First"], None, None, 2)
    assert pick(rows["I2"])[:3] == ("P9", "I2", "additional_isoform") and pick(rows["A1"])[:3] == ("A1", None, "additional_non_isoform") and len(rows) == 4
    assert c.first().gene == "HLA A" and a.where("sequence_id = 'I1'").first().parent_as_reported == "P1-2"
    empty = [x.limit(0) for x in (c, a, f)]
    assert S.loaded_sequences(*empty).count() == 0 and S.sequence_faults(*empty).count() == 0


def test_identifier_mappings(spark, tmp_path):
    rows = S.identifier_mappings(spark, put(tmp_path, "m.tab", "P1\tEnsembl\tENSG1.12\r\nP1\tGeneID\t7\n"))
    assert sorted(map(tuple, rows.collect())) == [("P1", "Ensembl", "ENSG1.12", "ENSG1"), ("P1", "GeneID", "7", "7")]
    for text in ("P1\tx\n", "P1\t\ty\n", "\n"):
        with pytest.raises(Exception, match="malformed mapping"):
            S.identifier_mappings(spark, put(tmp_path, "bad.tab", text)).select("database").collect()
