"""A data source for YAML: one row for each document of a file, its top-level value as JSON."""

from __future__ import annotations

import json

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class YamlReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.extensions = options.get("extensions", "yaml,yml").split(",")

    def partitions(self):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(root)
        infos = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        return [InputPartition(i.path) for i in sorted(infos, key=lambda i: i.path) if i.is_file and i.extension in self.extensions and i.base_name[0] not in "._"]

    def read(self, partition):
        import yaml
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_stream(partition.value) as f:
            for doc in yaml.safe_load_all(f.read().decode("utf-8")):
                if doc is not None:
                    yield partition.value, json.dumps(doc, default=str)


class YamlSource(DataSource):
    """``spark.read.format("yaml_docs").load(path)``: (file, body); parse body with ``from_json``.

    Option extensions: names to read, "yaml,yml" by default.  Empty documents give no rows; a broken
    file raises.
    """

    @classmethod
    def name(cls):
        return "yaml_docs"

    def schema(self):
        return "file string, body string"

    def reader(self, schema):
        return YamlReader(self.options)
