"""A Spark data source for gridded stores (Zarr, NetCDF) that xarray opens: one partition for a block of times."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, StructField, StructType, TimestampNTZType


class GridStore(DataSource):
    """Options: path (a file or store), variables (comma-separated), times (time steps of a partition, 24)."""

    @classmethod
    def name(cls) -> str:
        return "gridstore"

    def schema(self) -> StructType:
        import xarray

        with xarray.open_dataset(self.options["path"]) as store:
            names = self.options.get("variables", ",".join(store.data_vars)).split(",")
        kept = [StructField(n, DoubleType()) for n in names]
        return StructType([StructField("time", TimestampNTZType()), StructField("latitude", DoubleType()), StructField("longitude", DoubleType()), *kept])

    def reader(self, schema: StructType) -> DataSourceReader:
        return GridReader(self.options, schema)


class GridReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.step, self.names = options["path"], int(options.get("times", 24)), [f.name for f in schema.fields[3:]]

    def partitions(self) -> list[InputPartition]:
        import xarray

        with xarray.open_dataset(self.path) as store:
            n = next(store.sizes[d] for d in ("time", "date", "valid_time") if d in store.sizes)
        return [InputPartition((a, min(n, a + self.step))) for a in range(0, n, self.step)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        import xarray

        a, b = partition.value
        with xarray.open_dataset(self.path) as store:
            names = {d: n for d, n in (("date", "time"), ("valid_time", "time"), ("lat", "latitude"), ("lon", "longitude")) if d in store.dims}
            part = store.rename(names)[self.names].isel(time=slice(a, b)).transpose("time", "latitude", "longitude")
            frame = part.to_dataframe().reset_index()[["time", "latitude", "longitude", *self.names]]
        yield pa.RecordBatch.from_pandas(frame, preserve_index=False)
