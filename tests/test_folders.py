"""A folder with broken files: each is a row with its reason, all others are matched."""

from folioworks.operators import folders

BIB = "item_pos long, authors array<string>, title string, year int, doi string, isbn string"


def test_broken_files_do_not_end_the_job(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "Ferroresonance_in_Power_Grids_2020.txt").write_text("Ferroresonance in Power Grids by Иванов, 2020, a study of transformers and networks under load")
    (tmp_path / "in" / "page.HTML").write_text("<p>Ferroresonance in Power</p><script>x</script><p>Grids 2020 Иванов</p>")
    (tmp_path / "in" / "paper.tex").write_text(r"\section{Ferroresonance} in Power Grids \emph{Иванов}")
    (tmp_path / "old.txt").write_bytes("Иванов, тест".encode("cp1251"))
    (tmp_path / "blank.txt").write_text(" ")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "broken.md").write_text("boom")
    (tmp_path / "scan.pdf").write_bytes(b"%PDF")
    (tmp_path / "big.txt").write_text("x" * 5000)
    (tmp_path / "data.bin").write_bytes(b"Ferroresonance")

    def breaks(content):
        raise ValueError("cannot parse " + content.decode())

    readers = folders.READERS | {"markdown": breaks}
    bib = spark.createDataFrame([(1, ["Иванов"], "Ferroresonance in Power Grids", 2020, "", ""), (2, ["Nobody"], "Another title altogether", 1999, "", "")], BIB)
    exts = ["txt", "html", "tex", "md", "pdf"]
    got = {r["name"]: r for r in folders.match_folder(spark, f"file://{tmp_path}", bib, exts=exts, readers=readers, most_bytes=4000).collect()}
    assert {n for n, r in got.items() if r["matched"]} == {"Ferroresonance_in_Power_Grids_2020.txt", "page.HTML", "paper.tex", "old.txt"}
    assert all(got[n]["item_pos"] == 1 for n in got if got[n]["matched"])
    assert {n: r["error"] for n, r in got.items() if r["error"]} == {"broken.md": "ValueError: cannot parse boom", "scan.pdf": "no reader for pdf", "big.txt": "too large"}
    assert got["blank.txt"]["error"] is None and not got["blank.txt"]["matched"] and "data.bin" not in got and "empty.txt" not in got


def test_no_files(spark, tmp_path):
    (tmp_path / "other.bin").write_bytes(b"x")
    assert folders.read_folder(spark, f"file://{tmp_path}", ["txt"]).count() == 0


def test_files_hold_their_documents_in_order(spark, tmp_path):
    """Many files in a task: each holds its documents by doc_id, whatever the order of the table."""
    spark.range(30_000).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text").orderBy("text").write.parquet(f"{tmp_path}/documents.parquet")
    files = spark.read.option("recursiveFileLookup", True).text(f"{folders._written(spark, str(tmp_path))}/kind=txt", wholetext=True).collect()
    rows = [[int(x) for x in r["value"].split()] for r in files]
    assert len(rows) == 120 and all(r == list(range(r[0], r[0] + folders.IN_FILE)) for r in rows)
