"""One HTML file per sample: a Python data source whose tasks write files named by sample.

A task writes each file under a hidden name of its own and renames it, so that a file is whole or absent, and a task
that is run again puts the same content at the same name.  The files of finished tasks are removed when the job fails;
``_SUCCESS`` marks a finished one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .paths import filesystem

FORMAT = "html_per_sample"


@dataclass
class Written(WriterCommitMessage):
    """Names of the files of a finished task."""

    names: list[str]


class HtmlWriter(DataSourceWriter):
    def __init__(self, path: str, prefix: str):
        self.path, self.prefix = path.rstrip("/"), prefix

    def write(self, iterator: Iterator) -> Written:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        names, seen = [], set()
        for row in iterator:
            sample, html = row[0], row[1]
            if sample is None:
                raise ValueError("a sample without an id has no file name")
            name = f"{self.prefix}{quote(str(sample), safe='')}.html"
            if name in seen:
                raise ValueError(f"two rows of sample {sample}")
            seen.add(name)
            hidden = f"{root}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(hidden, compression=None) as out:
                out.write((html or "").encode())
            fs.move(hidden, f"{root}/{name}")
            names.append(name)
        return Written(names)

    def commit(self, messages: list) -> None:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        fs.open_output_stream(f"{root}/_SUCCESS", compression=None).close()

    def abort(self, messages: list) -> None:
        fs, root = filesystem(self.path)
        for message in messages:
            for name in message.names if message is not None else ():
                fs.delete_file(f"{root}/{name}")


class HtmlPerSample(DataSource):
    """``df.write.format("html_per_sample").mode("append").save(folder)``; the first column is the sample's id, the second
    its HTML; option ``prefix`` goes before the id in the file name."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: T.StructType, overwrite: bool) -> HtmlWriter:
        if overwrite:
            raise ValueError("files are added to the folder: use mode('append')")
        return HtmlWriter(self.options["path"], self.options.get("prefix", "sample-"))


def write_html_files(df: DataFrame, path: str, sample: str = "sample_id", html: str = "html", prefix: str = "sample-") -> None:
    """A file ``<prefix><sample>.html`` for each row (samples are distinct, as ``highlight_html`` gives them; a null id
    raises, null HTML is an empty file)."""
    df.sparkSession.dataSource.register(HtmlPerSample)
    df.select(sample, html).write.format(FORMAT).option("prefix", prefix).mode("append").save(path)


def read_html_files(spark: SparkSession, path: str, prefix: str = "sample-") -> DataFrame:
    """sample (text), html of every file of :func:`write_html_files`."""
    files = spark.read.option("pathGlobFilter", f"{prefix}*.html").text(path, wholetext=True)
    # Spark quotes the name of a file, which quotes the sample
    name = F.url_decode(F.col("_metadata.file_name"))
    sample = F.substring(name, len(prefix) + 1, F.length(name) - len(prefix + ".html"))
    return files.select(F.url_decode(sample).alias("sample"), F.col("value").alias("html"))
