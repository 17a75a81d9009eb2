"""Queries for readers, writers, caches and counters. Files are written by Spark from the tables first."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from ..functions.text import is_safe_id
from ..operators.featurize import FeatureCache, count_stages, featurize_sql, quarantine
from ..operators.screening import Heads, score_dot, screen_matrix
from ..operators.structure import annotate_structure, extract_sequence, residues
from ..operators.windows import top_k
from ..session import dealt, fresh_dir, spread
from ..sources import files, sinks, structures
from .registry import query, table
from .views import SCREEN_SQL, centroids, ligand_vectors


@query("read_fasta", """
  SELECT 'doc' || doc_id AS protein_id, length(s) AS n, md5(s) AS digest
  FROM (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS s FROM documents)
""")
def read_fasta(spark, folder):
    docs = spread(table(spark, folder, "documents", "doc_id", "lang", "text"))
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    wrapped = F.regexp_replace(letters, "(.{60})", "$1\n")
    path = fresh_dir(spark, "fasta")
    docs.select(F.concat(F.lit(">doc"), "doc_id", F.lit(" lang="), "lang", F.lit("\n"), wrapped)).write.text(path)
    back = files.read_fasta(spark, path)
    return back.select("protein_id", F.length("sequence").cast("long").alias("n"), F.md5("sequence").alias("digest"))


PART_SMILES = "concat_ws('-', p_name, p_brand, p_size)"


@query("read_smiles_csv", f"SELECT DISTINCT trim({PART_SMILES}) AS smiles FROM part")
def read_smiles_csv(spark, folder):
    path = fresh_dir(spark, "smiles-csv")
    part = table(spark, folder, "part")
    part.select(F.col("p_partkey").alias("ID"), F.expr(f"concat(' ', {PART_SMILES}, ' ')").alias("SMILES")).write.option(
        "header", True).csv(path)
    return files.read_smiles_csv(spark, path).select("smiles")


@query("read_smi", "SELECT DISTINCT replace(p_name, ' ', '_') || p_size AS smiles FROM part WHERE p_partkey % 10 <> 0")
def read_smi(spark, folder):
    path = fresh_dir(spark, "smi")
    part = table(spark, folder, "part")
    line = F.expr("concat(IF(p_partkey % 10 = 0, '#', ''), replace(p_name, ' ', '_'), p_size, ' ', p_brand)")
    part.select(line).write.text(path)
    return files.read_smi(spark, path).select("smiles")


@query("read_smiles_archives", f"SELECT DISTINCT {PART_SMILES} AS smiles FROM part")
def read_smiles_archives(spark, folder):
    """Archives of 500 parts each, with a resource fork, an unsafe member and an unused list beside the CSV."""
    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for chunk, names in zip(frame["chunk"], frame["names"]):
                members = [("._list.csv", "smiles\nbad\n"), ("../evil.csv", "smiles\nbad\n"), ("b.smi", "bad\n"),
                           ("a.csv", "id,Smiles\n" + "".join(f"{i},{s}\n" for i, s in enumerate(names)))]
                buffer = io.BytesIO()
                with tarfile.open(fileobj=buffer, mode="w:gz") as archive:
                    for name, text in members:
                        info = tarfile.TarInfo(name)
                        info.size = len(text.encode())
                        archive.addfile(info, io.BytesIO(text.encode()))
                yield pd.DataFrame({"path": [f"part-{chunk}.tar.gz"], "content": [buffer.getvalue()]})

    part = table(spark, folder, "part").select((F.col("p_partkey") / 500).cast("long").alias("chunk"), F.expr(PART_SMILES).alias("s"))
    archives = part.groupBy("chunk").agg(F.collect_list("s").alias("names")).mapInPandas(pack, "path string, content binary")
    return files.archive_ligands(archives).select("smiles")


@query("read_pairs", """
  SELECT CASE doc_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'valid' ELSE 'train' END AS split,
         'doc' || doc_id AS Protein, 'L' || quality AS Ligand,
         CASE WHEN doc_id % 5 > 1 AND doc_id % 7 = 0 THEN NULL ELSE doc_id / 4 END AS regression_label,
         CASE WHEN doc_id % 5 > 1 THEN toxic END AS classification_label,
         CAST(NULL AS INTEGER) AS multiclass_label
  FROM labels
""")
def read_pairs(spark, folder):
    path = fresh_dir(spark, "pairs")
    labels = table(spark, folder, "labels")
    base = [F.concat(F.lit("doc"), "doc_id").alias("Protein"), F.concat(F.lit("L"), "quality").alias("Ligand")]
    y = (F.col("doc_id") / 4).cast("string")
    parts = {
        "train": ("doc_id % 5 > 1", [*base, F.when(F.col("doc_id") % 7 == 0, "NaN").otherwise(y).alias("regression_label"),
                                     F.col("toxic").alias("classification_label")]),
        "test": ("doc_id % 5 = 0", [*base, y.alias("regression_label")]),
        "valid": ("doc_id % 5 = 1", [*base, y.alias("regression_label")]),
    }
    for name, (rule, columns) in parts.items():
        labels.where(rule).select(*columns).write.option("header", True).csv(f"{path}/{name}.csv")
    return files.read_pairs(spark, path)


@query("read_id_map", "SELECT s_name AS id, s_acctbal AS value FROM supplier")
def read_id_map(spark, folder):
    """JSON objects of a hundred suppliers each, one per file."""
    path = fresh_dir(spark, "id-map")
    supplier = table(spark, folder, "supplier")
    chunks = supplier.groupBy((F.col("s_suppkey") / 100).cast("long").alias("chunk")).agg(
        F.map_from_entries(F.collect_list(F.struct("s_name", "s_acctbal"))).alias("m"))
    chunks.select("chunk", F.to_json("m").alias("value")).write.partitionBy("chunk").text(path)
    return files.read_id_map(spark, path)


def _pdb_lines(spark, folder):
    """Customers as residues, 500 to a file; every seventh lacks its CA, every eleventh is a water."""
    customer = table(spark, folder, "customer").select(
        (F.col("c_custkey") / 500).cast("long").alias("structure"), (F.col("c_custkey") % 500).alias("resseq"),
        F.element_at(F.array(*[F.lit(n) for n in ("ALA", "GLY", "MSE", "SEC", "UNK", "TRP", "HIS", "QQQ")]),
                     (F.col("c_nationkey") % 8 + 1)).alias("res"),
        F.col("c_custkey"), F.col("c_acctbal"))
    resname = F.when(F.col("c_custkey") % 11 == 0, "HOH").otherwise(F.col("res"))
    atoms = F.when(F.col("c_custkey") % 7 == 0, F.array(F.lit("N"), F.lit("C"))).otherwise(
        F.array(F.lit("N"), F.lit("CA"), F.lit("C")))
    rows = customer.select("structure", "resseq", resname.alias("resname"), "c_acctbal", F.posexplode(atoms).alias("a", "atom"))
    line = F.format_string(
        "ATOM  %5d  %-3s %3s %s%4d    %8.3f%8.3f%8.3f  1.00%6.2f          %2s",
        F.col("resseq") * 3 + F.col("a"), "atom", "resname", F.when(F.col("resseq") < 250, "A").otherwise("B"),
        "resseq", F.col("resseq").cast("double"), F.col("a").cast("double"), F.floor("c_acctbal") / 8,
        F.lit(20.0), F.substring("atom", 1, 1))
    first = rows.select("structure", F.col("resseq").cast("long").alias("at"), F.col("a").cast("long").alias("a"), line.alias("value"))
    ends = customer.select("structure").distinct().select(
        "structure", F.explode(F.array(
            F.struct(F.lit(-1).alias("at"), F.lit("MODEL        1").alias("value")),
            F.struct(F.lit(1000).alias("at"), F.lit("ENDMDL").alias("value")),
            F.struct(F.lit(1001).alias("at"), F.lit("ATOM      1  N   ALA A   1       1.000   1.000   1.000  1.00 20.00           N").alias("value")))).alias("s"))
    ends = ends.select("structure", F.col("s.at").cast("long").alias("at"), F.lit(0).cast("long").alias("a"), F.col("s.value").alias("value"))
    path = fresh_dir(spark, "pdb")
    # A file holds 500 residues at most.
    whole = first.unionByName(ends).groupBy("structure").agg(F.array_sort(F.collect_list(F.struct("at", "a", "value"))).alias("l"))
    whole.select("structure", F.concat_ws("\n", F.col("l.value"))).write.partitionBy("structure").text(path)
    return structures.read_pdb_atoms(spark, f"{path}/structure=*")


RESIDUES_SQL = """
  res AS (SELECT c_custkey // 500 AS structure, c_custkey % 500 AS resseq, c_custkey, c_acctbal,
                 CASE WHEN c_custkey % 11 = 0 THEN 'HOH' ELSE
                   (['ALA','GLY','MSE','SEC','UNK','TRP','HIS','QQQ'])[c_nationkey % 8 + 1] END AS resname
          FROM customer),
  atoms AS (SELECT structure, resseq, resname, c_acctbal, c_custkey, unnest(
                   CASE WHEN c_custkey % 7 = 0 THEN ['N','C'] ELSE ['N','CA','C'] END) AS atom FROM res)
"""
def _structure():
    return F.regexp_extract("path", r"structure=(\d+)", 1).cast("long").alias("structure")


@query("read_pdb_atoms", f"""
  WITH {RESIDUES_SQL}
  SELECT structure, resname, count(*) AS atoms, CAST(sum(resseq) AS BIGINT) AS resseqs,
         round(sum(floor(c_acctbal) / 8), 2) AS z, min(atom) AS first_atom, sum(CASE WHEN resseq < 250 THEN 1 ELSE 0 END)::BIGINT AS chain_a
  FROM atoms GROUP BY ALL
""")
def read_pdb_atoms(spark, folder):
    atoms = _pdb_lines(spark, folder).withColumn("structure", _structure())
    return atoms.groupBy("structure", "resname").agg(
        F.count(F.lit(1)).alias("atoms"), F.sum("resseq").cast("long").alias("resseqs"), F.round(F.sum("z"), 2).alias("z"),
        F.min("atom").alias("first_atom"), F.count_if(F.col("chain") == "A").alias("chain_a"))


CODE_SQL = "CASE resname WHEN 'ALA' THEN 'A' WHEN 'GLY' THEN 'G' WHEN 'MSE' THEN 'M' WHEN 'SEC' THEN 'C' WHEN 'TRP' THEN 'W' WHEN 'HIS' THEN 'H' ELSE 'X' END"


@query("extract_sequence", f"""
  WITH {RESIDUES_SQL}
  SELECT structure, string_agg({CODE_SQL}, '' ORDER BY resseq) AS sequence,
         string_agg(CASE WHEN resseq < 250 THEN 'A' ELSE 'B' END, '' ORDER BY resseq) AS chains
  FROM res WHERE resname <> 'HOH' AND c_custkey % 7 <> 0 GROUP BY structure
""")
def extract_sequence_query(spark, folder):
    return extract_sequence(_pdb_lines(spark, folder)).select(_structure(), "sequence", "chains")


@query("annotate_structure", f"""
  WITH {RESIDUES_SQL},
  scored AS (SELECT structure, resseq, row_number() OVER (PARTITION BY structure ORDER BY resseq) - 1 AS i
             FROM res WHERE resname <> 'HOH' AND c_custkey % 7 <> 0)
  SELECT a.structure, a.resseq, a.atom, coalesce((i % 10) / 10.0, 0.0)::DOUBLE AS score
  FROM atoms a LEFT JOIN scored USING (structure, resseq)
""")
def annotate_structure_query(spark, folder):
    atoms = _pdb_lines(spark, folder)
    scores = residues(atoms).select("path", "res_index", "code", ((F.col("res_index") % 10) / 10).alias("score"))
    return annotate_structure(atoms, scores).select(_structure(), F.col("resseq").cast("long").alias("resseq"), "atom", "score")


@query("read_ligand_files", """
  WITH m AS (SELECT s_suppkey, 3 + s_suppkey % 5 AS n FROM supplier)
  SELECT s_suppkey AS molecule, n AS atoms, n - 1 AS bonds,
         CAST((n + 1) // 2 AS BIGINT) AS carbons, round(n * (n - 1) / 2.0 * 1.5, 3)::DOUBLE AS x
  FROM m
""")
def read_ligand_files(spark, folder):
    """A molecule per supplier, as SDF, MOL2 or PDBQT text by turns; SDF files carry a second molecule."""
    n = F.col("n")
    # The few rows become many files, which all cores write; rows of one molecule share a file.
    base = dealt(table(spark, folder, "supplier", "s_suppkey"), "s_suppkey").select(F.col("s_suppkey").alias("m"), (F.lit(3) + F.col("s_suppkey") % 5).cast("int").alias("n"))
    at = F.sequence(F.lit(0), n - 1)

    def symbol(i):
        return F.when(i % 2 == 0, "C").otherwise("O")

    def joined(values):
        return F.concat_ws("\n", values)

    sdf_atoms = joined(F.transform(at, lambda i: F.format_string("%10.4f%10.4f%10.4f %-3s 0  0", i * 1.5, F.lit(0.0), F.lit(0.0), symbol(i))))
    sdf_bonds = joined(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.format_string("%3d%3d%3d  0", i, i + 1, i % 2 + 1)))
    sdf = F.concat(F.lit("mol\n  made\n\n"), F.format_string("%3d%3d  0  0", n, n - 1), F.lit("\n"), sdf_atoms, F.lit("\n"),
                   sdf_bonds, F.lit("\nM  END\n$$$$\nsecond\n\n\n  1  0\n    9.0000    0.0000    0.0000 N   0  0\nM  END\n$$$$"))
    mol2_atoms = joined(F.transform(at, lambda i: F.format_string("%d %s%d %.3f 0.0 0.0 %s.3 1 LIG 0.0", i + 1, symbol(i), i + 1, i * 1.5, symbol(i))))
    mol2_bonds = joined(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.format_string("%d %d %d ar", i, i, i + 1)))
    mol2 = F.concat(F.lit("@<TRIPOS>MOLECULE\nm\n@<TRIPOS>ATOM\n"), mol2_atoms, F.lit("\n@<TRIPOS>BOND\n"), mol2_bonds)
    pdb_line = "HETATM%5d  %-3s LIG A   1    %8.3f   0.000   0.000  1.00 20.00          %2s"
    pdb_atoms = joined(F.transform(at, lambda i: F.format_string(pdb_line, i + 1, symbol(i), i * 1.5, symbol(i))))
    conect = joined(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.format_string("CONECT%5d%5d", i, i + 1)))
    kinds = {"sdf": sdf, "mol2": mol2, "pdb": F.concat(pdb_atoms, F.lit("\n"), conect)}
    path = fresh_dir(spark, "ligands")
    for turn, (suffix, text) in enumerate(kinds.items()):
        # The text writer names files .txt; the folder carries the molecule, the reader takes the suffix apart.
        rows = base.where(F.col("m") % 3 == turn).select(F.col("m").alias("molecule"), text.alias("value"))
        # Each task puts its own files in place, where the driver would move them one by one.
        rows.write.option("mapreduce.fileoutputcommitter.algorithm.version", 2).partitionBy("molecule").text(f"{path}/{suffix}")
    texts = spark.read.option("recursiveFileLookup", True).text([f"{path}/{suffix}" for suffix in kinds], wholetext=True)
    name = F.concat(F.regexp_extract("path", r"(molecule=\d+)", 1), F.lit("."), F.regexp_extract("path", r"/([a-z0-9]+)/molecule=", 1))
    atoms, bonds = structures.parse_ligands(texts.select(F.col("_metadata.file_path").alias("path"), "value").withColumn("path", name))
    molecule = F.regexp_extract("path", r"molecule=(\d+)", 1).cast("long").alias("molecule")
    per_atom = atoms.groupBy(molecule).agg(
        F.count(F.lit(1)).alias("atoms"), F.count_if(F.col("symbol") == "C").alias("carbons"), F.round(F.sum("x"), 3).alias("x"))
    per_bond = bonds.groupBy(molecule).agg(F.count(F.lit(1)).alias("bonds"))
    return per_atom.join(per_bond, "molecule").select("molecule", "atoms", "bonds", "carbons", "x")


@query("feature_cache", """
  SELECT sha256(text) AS sha, CAST(length(text) AS BIGINT) AS value,
         CASE WHEN bool_or(doc_id % 2 = 0) THEN 'hit' ELSE 'miss' END AS state
  FROM documents GROUP BY text
""")
def feature_cache(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text")

    def lengths(keys):
        return featurize_sql(keys, "text", F.length("text").cast("long"), F.lit(None).cast("string"))

    cache = FeatureCache(spark, fresh_dir(spark, "cache"), "bigint")
    cache.get_or_compute(docs.where("doc_id % 2 = 0"), "text", lengths)
    result = cache.get_or_compute(docs, "text", lengths)
    states = result.hits.withColumn("state", F.lit("hit")).unionByName(result.misses.withColumn("state", F.lit("miss")))
    return result.features.join(states, "sha").select("sha", "value", "state")


@query("write_scores", f"""
  WITH {SCREEN_SQL}
  SELECT CAST(protein_id AS INTEGER) AS protein_id, smiles, round(prediction, 4) AS prediction,
         round(1 / (1 + exp(-prediction)), 4) AS predicted_binary_interaction, CAST(64 AS INTEGER) AS protein_length
  FROM scored
""")
def write_scores(spark, folder):
    heads = Heads(regression=True, classification=True)
    scored = score_dot(screen_matrix(ligand_vectors(spark, folder), centroids(spark, folder), "smiles", "protein_id"),
                       "ligand_vec", "protein_vec")
    scored = scored.withColumn("predicted_binary_interaction", 1 / (1 + F.exp(-F.col("prediction"))))
    scored = scored.withColumn("protein_length", F.size("protein_vec"))
    path = fresh_dir(spark, "scores")
    sinks.write_scores(scored, path, heads)
    schema = "protein_id int, smiles long, prediction double, predicted_binary_interaction double, protein_length int"
    return spark.read.option("header", True).schema(schema).csv(path)


@query("write_interpretation", f"""
  WITH {SCREEN_SQL},
  best AS (SELECT *, row_number() OVER (PARTITION BY protein_id ORDER BY prediction DESC, smiles) AS rank FROM scored),
  pos AS (SELECT protein_id, smiles, generate_subscripts(embedding, 1) AS residue_id, unnest(embedding)::DOUBLE AS raw
          FROM best JOIN embeddings ON vec_id = smiles WHERE rank <= 3)
  SELECT 'P_' || protein_id AS protein_id, 'P_' || protein_id || '__' || sha256(CAST(smiles AS VARCHAR)) AS pair_id,
         CAST(residue_id AS INTEGER) AS residue_id, round(raw, 6) AS raw
  FROM pos
""")
def write_interpretation(spark, folder):
    """Second pass over the survivors of the top-K only."""
    ligands = ligand_vectors(spark, folder)
    scored = score_dot(screen_matrix(ligands, centroids(spark, folder), "smiles", "protein_id"), "ligand_vec", "protein_vec")
    best = top_k(scored.select("protein_id", "smiles", "prediction"), ["protein_id"], "prediction", 3, ["smiles"])
    rows = best.join(ligands, "smiles").select(
        F.concat(F.lit("P:"), "protein_id").alias("protein_id"), F.col("smiles").cast("string").alias("smiles"),
        F.posexplode("ligand_vec").alias("pos", "raw"))
    path = fresh_dir(spark, "interpretation")
    sinks.write_interpretation(rows.select("protein_id", "smiles", (F.col("pos") + 1).alias("residue_id"), F.col("raw").cast("double").alias("raw")), path)
    back = spark.read.schema("residue_id int, raw double, protein_id string, pair_id string").parquet(f"{path}/pairs")
    return back.select("protein_id", "pair_id", "residue_id", F.round("raw", 6).alias("raw"))


@query("quarantine", """
  SELECT CASE WHEN length(text) < 100 THEN 'too short' WHEN contains(text, 'ñ') THEN 'foreign letter' END AS error,
         count(*) AS n, CAST(sum(CASE WHEN length(text) >= 100 AND NOT contains(text, 'ñ') THEN length(text) END) AS BIGINT) AS total
  FROM (SELECT DISTINCT text FROM conversations) GROUP BY 1
""")
def quarantine_query(spark, folder):
    texts = table(spark, folder, "conversations", "text")
    error = F.when(F.length("text") < 100, "too short").when(F.col("text").contains("ñ"), "foreign letter")
    good, failed = quarantine(featurize_sql(texts, "text", F.length("text").cast("long"), error))
    kept = good.select(F.lit(None).cast("string").alias("error"), "value")
    lost = failed.select("error", F.lit(None).cast("long").alias("value"))
    return kept.unionByName(lost).groupBy("error").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("pipeline_counters", """
  SELECT 'proteins' AS stage, count(*) AS n FROM supplier
  UNION ALL SELECT 'ligands', count(*) FROM part
  UNION ALL SELECT 'unique ligands', count(DISTINCT lower(trim(p_name))) FROM part
  UNION ALL SELECT 'pairs', count(*) FROM lineitem
  UNION ALL SELECT 'unsafe ids', count(*) FROM pages WHERE contains(regexp_replace(url, '[/\\\\:*?"<>|]', '_', 'g'), '..')
""")
def pipeline_counters(spark, folder):
    part = table(spark, folder, "part")
    return count_stages(**{
        "proteins": table(spark, folder, "supplier"), "ligands": part,
        "unique ligands": part.select(F.lower(F.trim("p_name"))).distinct(),
        "pairs": table(spark, folder, "lineitem"),
        "unsafe ids": table(spark, folder, "pages").where(~is_safe_id(F.col("url"))),
    })
