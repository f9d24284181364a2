"""The tailing source: new whole lines, replaced files, restarts."""

from tracewell.streaming.tail import TailReader, TailSource


def lines(reader, start, end):
    return [row[1] for p in reader.partitions(start, end) for row in reader.read(p)]


def test_offsets(tmp_path):
    f = tmp_path / "a.log"
    f.write_text("one\ntwo\nhalf")
    reader = TailReader({"path": str(tmp_path / "*.log")})
    first = reader.latestOffset()
    assert lines(reader, {}, first) == ["one", "two"]
    with f.open("a") as out:
        out.write(" line\nthree\n")
    second = reader.latestOffset()
    assert lines(reader, first, second) == ["half line", "three"]
    f.unlink()
    f.write_text("new\n")
    assert lines(reader, second, reader.latestOffset()) == ["new"]
    assert TailReader({"path": str(tmp_path / "*.log"), "start": "end"}).initialOffset()[str(f)][1] == 4
    assert TailReader({"path": str(tmp_path / "none*")}).latestOffset() == {}


def test_stream(spark, tmp_path):
    (tmp_path / "a.log").write_text("".join(f"line {i}\n" for i in range(50)) + "unfinished")
    spark.dataSource.register(TailSource)
    query = spark.readStream.format("tail").option("path", str(tmp_path / "*.log")).load().writeStream.format("memory").queryName("tailed").start()
    try:
        query.processAllAvailable()
        with (tmp_path / "a.log").open("a") as out:
            out.write(" now finished\n")
        query.processAllAvailable()
        got = [r.line for r in spark.sql("select line from tailed").collect()]
    finally:
        query.stop()
    assert got == [f"line {i}" for i in range(50)] + ["unfinished now finished"]
