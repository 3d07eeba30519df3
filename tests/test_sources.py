from quarry.sources import files as FS


def test_page_csv_round_trip(spark, tmp_table):
    rows = [("", "https://s/1", 0, "T 1", "1", "N/A"),
            ('He said "hi", then\nleft', "https://s/PS12", 1, 'A "q"', "N/A", "PS12"),
            ("a,b", "https://s/3", 2, "x", "N/A", "N/A")]
    df = spark.createDataFrame(rows, FS.PAGE_CSV)
    path = tmp_table("csv")
    FS.append_page_csv(df.limit(1), path)
    FS.append_page_csv(df.subtract(df.limit(1)), path)
    back = sorted(tuple(r) for r in FS.scan_page_csv(spark, path).collect())
    assert back == sorted(rows)


def test_crawl_items_empty_text(spark, tmp_table):
    path = tmp_table("items")
    FS.write_crawl_items(spark.createDataFrame([(None, "u1"), ("t", "u2")], "text string, url string"), path)
    got = sorted(tuple(r) for r in FS.map_crawl_items(spark, path).collect())
    assert got == [("", "u1"), ("t", "u2")]


def test_text_url_csv_source_is_the_file(spark, tmp_table):
    path = tmp_table("text-url")
    FS.write_text_url_csv(spark.createDataFrame([("t1", "https://s/1"), ("", "https://s/2")], "text string, url string"),
                          path)
    rows = sorted((r.text, r.url, r.source.endswith(".csv")) for r in FS.scan_text_url_csv(spark, path).collect())
    assert rows == [("", "https://s/2", True), ("t1", "https://s/1", True)]


def test_compose_document_body(spark):
    from quarry.operators.index import compose_document

    rec = spark.createDataFrame([(7, " body text ", "https://s/PS1", 2, "T 1", "1", "PS1")],
                                "page_id long, text string, url string, depth int, title string, "
                                "model_num string, ps_num string")
    d = compose_document(rec).first()
    assert d.page_content == "text: body text\nurl: https://s/PS1"
    assert (d.doc_id, d.url, d.depth, d.model_num, d.ps_num) == (7, "https://s/PS1", 2, "1", "PS1")


def test_page_store_round_trip_and_pruning(spark, tmp_table):
    rows = [("", "https://s/1", 0, "T 1", "1", "N/A"), ("x\ny", "https://s/2", 1, "t", "N/A", "PS2"), ("deep", "https://s/3", 7, "t", "N/A", "N/A"),
            ("unreached", "https://s/4", None, "t", "N/A", "N/A")]
    df, path = spark.createDataFrame(rows, FS.PAGE_CSV), tmp_table("store")
    FS.append_pages(df.filter("depth = 0"), path)
    FS.append_pages(df.filter("depth is null or depth > 0"), path)
    assert sorted(map(repr, map(tuple, FS.scan_pages(spark, path).collect()))) == sorted(map(repr, rows))
    some = FS.scan_pages(spark, path, max_depth=1)
    assert sorted(r.url for r in some.collect()) == ["https://s/1", "https://s/2"]
    assert "PartitionFilters: [isnotnull(depth" in some._jdf.queryExecution().toString()


def test_csv_files_are_bounded(spark, tmp_table):
    df = spark.createDataFrame([("w" * 1000, f"https://s/{i}", 0, "t", "N/A", "N/A") for i in range(100)], FS.PAGE_CSV).coalesce(1)
    path = tmp_table("bounded")
    FS.append_page_csv(df, path, file_bytes=10_000)
    back = FS.scan_page_csv(spark, path)
    assert back.count() == 100 and len(back.inputFiles()) >= 10
