from quillspark.sources import office


def test_page_sections(spark):
    body = "x" * 60
    pages = [("a", 1, f"lost\nCAPÍTULO I\n{body}"), ("a", 2, f"\n  second  \nArt. 2 Título\nshort\n§ 1\n{body}"), ("b", 1, " nothing here "), ("b", 2, None)]
    out = office.page_sections(spark.createDataFrame(pages, "path string, page_number int, text string"))
    got = sorted((r.path, r.position, r.title, r.level, r.type, r.page_number, r.content) for r in out.collect())
    assert got == [
        ("a", 1, "CAPÍTULO I", 1, "chapter", 1, body + "\nsecond"),
        ("a", 3, "§ 1", 4, "paragraph", 2, body),
        ("b", 1, "Documento Completo", 1, "full_document", 1, "nothing here"),
    ]


def test_readers(spark, tmp_path):
    (tmp_path / "one.pdf").write_bytes(b"p1|p2")
    (tmp_path / "two.pdf").write_bytes(b"bad")

    def read(data):
        if data == b"bad":
            raise ValueError("broken")
        return data.decode().split("|")

    found = office.files(spark, str(tmp_path), "*.pdf")
    got = sorted((r.path[-7:], r.page_number, r.text, r.error) for r in office.pdf_pages(found, read).collect() if r.error is None)
    assert got == [("one.pdf", 1, "p1", None), ("one.pdf", 2, "p2", None)]
    assert [r.error for r in office.pdf_pages(found, read).where("error is not null").collect()] == ["ValueError: broken"]
    rows = {r.path[-7:]: r for r in office.markdown_of(found, lambda data, ext: f"{ext} {len(data)}").collect()}
    assert rows["one.pdf"].markdown == ".pdf 5" and len(rows["two.pdf"].content_sha256) == 64
    assert all(r.error.startswith("ValueError: unsupported") for r in office.markdown_of(found).collect())
