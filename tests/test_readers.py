"""Image files are numbered by name, decoded by the package or by Spark, and what can't be decoded is named."""

import numpy as np

from lineleaf.sources import readers


def test_numbers_decoding_and_reasons(spark, tmp_path):
    r = np.random.default_rng(4)
    color, gray = r.integers(0, 256, (5, 7, 3), dtype=np.uint8), r.integers(0, 256, (4, 6), dtype=np.uint8)
    (tmp_path / "B.png").write_bytes(readers.png_bytes(color, 300))
    (tmp_path / "a.png").write_bytes(readers.png_bytes(gray))
    (tmp_path / "d.txt").write_bytes(b"no image")
    jvm = spark._jvm
    picture = jvm.java.awt.image.BufferedImage(8, 3, 5)
    assert jvm.javax.imageio.ImageIO.write(picture, "jpg", jvm.java.io.File(str(tmp_path / "C.jpg")))
    files = readers.image_files(spark, str(tmp_path))
    assert [(x.number, x.name) for x in files.orderBy("number").collect()] == [(0, "a.png"), (1, "b.png"), (2, "c.jpg"), (3, "d.txt")]
    assert sorted(x.number for x in readers.undecoded(files).collect()) == [2, 3]
    own = {x.page: x for x in readers.pages_of(files).collect()}
    assert set(own) == {0, 1} and round(own[1].dpi) == 300 and own[0].dpi == readers.DEFAULT_DPI
    seen = {x.page: x for x in readers.decoded_images(spark, str(tmp_path)).collect()}
    assert set(seen) == {0, 1, 2} and (seen[2].height, seen[2].width, seen[2].channels) == (3, 8, 3)
    for page in own:
        assert bytes(seen[page].pixels) == bytes(own[page].pixels) and seen[page].channels == own[page].channels


def test_numbers_over_many_partitions(spark):
    df = spark.range(1000, numPartitions=13).selectExpr("(id * 7919) % 1000 as v").repartition(7)
    got = readers.numbered(df, ["v"]).collect()
    assert len(got) == 1000 and all(x.number == x.v for x in got)
    assert readers.numbered(df.where("v < 0"), ["v"]).count() == 0
