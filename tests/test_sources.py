import io
import random
import tarfile

import pytest

from pairspark.sources import files, sinks, structures


def write(path, text):
    path.write_bytes(text.encode())
    return str(path)


def fasta(spark, tmp_path, text):
    return {r["protein_id"]: r["sequence"] for r in files.read_fasta(spark, write(tmp_path / "p.fasta", text)).collect()}


def test_fasta_joins_lines_and_takes_first_token(spark, tmp_path):
    assert fasta(spark, tmp_path, ">P1 some protein\nMKT\nAYI\n>sp|X|Y desc\nGGG\n\n>P3\nAC\n") == {
        "P1": "MKTAYI", "sp|X|Y": "GGG", "P3": "AC"}


def test_fasta_empty_file(spark, tmp_path):
    assert fasta(spark, tmp_path, "") == {}


def test_fasta_last_record_of_an_id_wins(spark, tmp_path):
    assert fasta(spark, tmp_path, ">A\nMK\n>B\nCC\n>A\nGG\n") == {"A": "GG", "B": "CC"}


def test_fasta_windows_line_ends_and_text_before_the_first_header(spark, tmp_path):
    assert fasta(spark, tmp_path, "stray text\r\n>A x\r\nMK\r\nTT\r\n>B\r\n\r\nCC") == {"A": "MKTT", "B": "CC"}


def test_fasta_stray_text_only_dropped_in_its_own_file(spark, tmp_path):
    (tmp_path / "d").mkdir()
    write(tmp_path / "d" / "a.fa", "stray\n>A\nMK\n>C\nTT\n")
    write(tmp_path / "d" / "b.fa", ">B\nCC\n")
    rows = {r[0]: r[1] for r in files.read_fasta(spark, str(tmp_path / "d")).collect()}
    assert rows == {"A": "MK", "B": "CC", "C": "TT"}


def test_fasta_record_without_sequence(spark, tmp_path):
    assert fasta(spark, tmp_path, ">A\n>B\nCC\n") == {"A": "", "B": "CC"}


def test_fasta_empty_header_raises(spark, tmp_path):
    with pytest.raises(Exception, match="without an id"):
        fasta(spark, tmp_path, ">\nMK\n>B\nCC\n")


def smiles(df):
    return [r["smiles"] for r in df.orderBy("ord").collect()]


def test_smiles_csv_header_and_first_seen_order(spark, tmp_path):
    path = write(tmp_path / "l.csv", "ID,SMILES\n1,CCO\n2,c1ccccc1\n3,CCO\n4, \n5\n")
    assert smiles(files.read_smiles_csv(spark, path)) == ["CCO", "c1ccccc1"]


def test_smiles_csv_mixed_case_header(spark, tmp_path):
    assert smiles(files.read_smiles_csv(spark, write(tmp_path / "l.csv", "id,Smiles\n1,CC\n"))) == ["CC"]


def test_smiles_csv_falls_back_to_the_first_column(spark, tmp_path):
    assert smiles(files.read_smiles_csv(spark, write(tmp_path / "l.csv", "compound,activity\nCC,1\nCO,2\n"))) == ["CC", "CO"]


def test_smiles_csv_empty_file_raises(spark, tmp_path):
    with pytest.raises(ValueError, match="empty CSV"):
        files.read_smiles_csv(spark, write(tmp_path / "l.csv", ""))


def test_smi(spark, tmp_path):
    path = write(tmp_path / "l.smi", "# list\nCCO ethanol\n\nc1ccccc1\tbenzene\nCCO again\n")
    assert smiles(files.read_smiles_auto(spark, path)) == ["CCO", "c1ccccc1"]


def test_auto_reads_an_unknown_suffix_as_csv(spark, tmp_path):
    assert smiles(files.read_smiles_auto(spark, write(tmp_path / "l.txt", "smiles\nCC\n"))) == ["CC"]


def archive(path, members):
    with tarfile.open(path, "w:gz") as tar:
        for name, text in members:
            info = tarfile.TarInfo(name)
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text.encode()))
    return str(path)


def test_archive_prefers_csv_and_skips_unsafe_members(spark, tmp_path):
    path = archive(tmp_path / "l.tar.gz", [
        ("._x.csv", "smiles\nbad\n"), ("../evil.csv", "smiles\nbad\n"), ("b.smi", "bad\n"), ("d/a.csv", "smiles\nCC\nCO\nCC\n")])
    assert smiles(files.read_smiles_auto(spark, path)) == ["CC", "CO"]


def test_archive_with_smi_only_and_with_neither_suffix(spark, tmp_path):
    assert smiles(files.read_smiles_auto(spark, archive(tmp_path / "a.tgz", [("x.txt", "bad\n"), ("b.smi", "CC name\n#c\n")]))) == ["CC"]
    assert smiles(files.read_smiles_auto(spark, archive(tmp_path / "b.tgz", [("x.txt", "smi,n\nCN,1\n")]))) == ["CN"]


def test_pairs_with_optional_labels_and_no_valid_file(spark, tmp_path):
    write(tmp_path / "train.csv", "Protein,Ligand,regression_label,multiclass_label\nMK,CC,NaN,-1\nMK,CO,5.5,999\n")
    write(tmp_path / "test.csv", "Protein,Ligand\nGG,CC\n")
    rows = {(r["split"], r["Ligand"]): r for r in files.read_pairs(spark, str(tmp_path)).collect()}
    assert len(rows) == 3
    assert rows["train", "CC"]["regression_label"] is None and rows["train", "CO"]["regression_label"] == 5.5
    assert rows["train", "CO"]["multiclass_label"] == 999 and rows["train", "CO"]["classification_label"] is None
    assert rows["test", "CC"]["regression_label"] is None


def test_id_map(spark, tmp_path):
    rows = files.read_id_map(spark, write(tmp_path / "m.json", '{"a": 1.5,\n "b": 2}')).collect()
    assert {r["id"]: r["value"] for r in rows} == {"a": 1.5, "b": 2.0}


PDB = """MODEL        1
ATOM      1  N   ALA A   1      11.104   6.134  -6.504  1.00 20.00           N
ATOM      2  CA  ALA A   1      11.639   6.071  -5.147  1.00 21.50           C
ATOM      3  C   ALA A   1      12.000   6.000  -4.000  1.00 20.00           C
ATOM      4  CA  GLY A   2      13.000   6.000  -4.000  1.00 20.00           C
HETATM    5  N   MSE B   1      14.000   6.000  -4.000  1.00 20.00           N
HETATM    6  CA  MSE B   1      15.000   6.000  -4.000  1.00 20.00           C
HETATM    7  C   MSE B   1      16.000   6.000  -4.000  1.00 20.00           C
HETATM    8  O   HOH B   9      16.000   6.000  -4.000  1.00 20.00           O
ENDMDL
MODEL        2
ATOM      1  N   TRP A   1      11.104   6.134  -6.504  1.00 20.00           N
ENDMDL
"""


def test_pdb_first_model_and_sequence(spark, tmp_path):
    from pairspark.operators.structure import annotate_structure, extract_sequence, residues

    atoms = structures.read_pdb_atoms(spark, write(tmp_path / "a.pdb", PDB))
    rows = atoms.orderBy("line_no").collect()
    assert len(rows) == 8 and rows[1]["bfactor"] == 21.5 and rows[0]["x"] == 11.104 and rows[4]["record"] == "HETATM"
    assert [tuple(r)[1:] for r in extract_sequence(atoms).collect()] == [("AM", "AB")]
    scores = residues(atoms).selectExpr("path", "res_index", "code", "res_index + 1.0D AS score")
    scored = {r["serial"]: r["score"] for r in annotate_structure(atoms, scores).collect()}
    assert scored == {1: 1.0, 2: 1.0, 3: 1.0, 4: 0.0, 5: 2.0, 6: 2.0, 7: 2.0, 8: 0.0}
    wrong = scores.selectExpr("path", "res_index", "'W' AS code", "score")
    with pytest.raises(Exception, match="residue letter differs"):
        annotate_structure(atoms, wrong).collect()


def test_unknown_structure_suffix_raises(spark, tmp_path):
    atoms, _ = structures.read_ligand_files(spark, write(tmp_path / "a.xyz", "1\n"))
    with pytest.raises(Exception, match="unknown structure suffix"):
        atoms.collect()


def test_pdbqt_lines_are_cut(spark, tmp_path):
    line = "HETATM    1  C1  LIG A   1       1.000   2.000   3.000  1.00 20.00     0.123 OA\n"
    atoms, _ = structures.read_ligand_files(spark, write(tmp_path / "a.pdbqt", line))
    assert [tuple(r)[1:] for r in atoms.collect()] == [(1, "C", 1.0, 2.0, 3.0)]


def test_fasta_split_inside_records(spark, tmp_path):
    """Small splits cut the file anywhere; every record is read once, in file order."""
    rng = random.Random(3)
    records = [(f"P{i % 150}", "".join(rng.choices("ACDEFGHIKL", k=rng.randint(0, 200)))) for i in range(300)]
    text = "stray\n" + "".join(f">{name} x\n{seq[:80]}\n{seq[80:]}\n" for name, seq in records)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        assert fasta(spark, tmp_path, text) == dict(records)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_pairs_of_an_interpretation_table_lie_in_few_files(spark, tmp_path):
    path = str(tmp_path / "interpretation")
    rows = spark.range(3000).selectExpr("concat('P:', id % 7) AS protein_id", "concat('C', id % 500) AS smiles", "id AS residue_id", "id / 2 AS raw")
    sinks.write_interpretation(rows, path, buckets=4)
    whole = spark.read.parquet(f"{path}/pairs")
    assert len(whole.inputFiles()) <= 4 and whole.count() == 3000
    lookup = spark.read.parquet(f"{path}/lookup").collect()
    assert sum(r["pairs"] for r in lookup) == rows.select("protein_id", "smiles").distinct().count()
    one = sinks.read_pair(spark, path, "P:3", "C3", "residue_id long, raw double")
    assert len(one.inputFiles()) == 1
    want = rows.where("protein_id = 'P:3' AND smiles = 'C3'")
    assert sorted(r["residue_id"] for r in one.collect()) == sorted(r["residue_id"] for r in want.collect())
    assert sinks.read_pair(spark, path, "P:3", "none", "residue_id long, raw double").collect() == []


def test_ligand_files_are_read_once(spark, tmp_path):
    path = write(tmp_path / "a.pdb", "HETATM    1  C1  LIG A   1       1.000   2.000   3.000  1.00 20.00           C\n"
                                     "HETATM    2  O1  LIG A   1       1.500   2.000   3.000  1.00 20.00           O\nCONECT    1    2\n")
    atoms, bonds = structures.read_ligand_files(spark, path)
    for rows in (atoms, bonds):
        assert "FileScan" not in rows._jdf.queryExecution().toString()
    assert [tuple(r)[1:] for r in atoms.orderBy("idx").collect()] == [(1, "C", 1.0, 2.0, 3.0), (2, "O", 1.5, 2.0, 3.0)]
    assert [tuple(r)[1:] for r in bonds.collect()] == [(1, 2, "UNSPECIFIED")]
