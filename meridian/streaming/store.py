"""Catalog store: fields ingested one after another, their detections linked to objects by position.

Three Parquet tables below one folder: ``detections`` (a folder a field), ``founders`` (the detections that founded an object, by
coarse HEALPix pixel) and ``commits`` (one row a field). A field's rows are written under the name of the attempt and count once
its commit row exists, which comes last; a field that is committed is skipped. So an ingest that failed or is repeated changes nothing.
An object is named by its founder's detection_id; its counts are aggregated from the detections when it is read.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import finite
from ..functions.sky import healpix, separation
from ..operators.catalog import cone_cover
from ..operators.match import nearest, sky_pairs
from ..operators.rounds import cut, shared_folder

FINE, COARSE = 8192, 128
_SHIFT = 2 * (FINE.bit_length() - COARSE.bit_length())
#: A field that touches more coarse pixels than this reads all founders instead of a list of folders.
MOST_FOLDERS = 2000
#: Side in degrees of the squares in which a field's positions are taken together to find the coarse pixels they touch.
GRID = 0.01
#: Ranges of the fine index in a cone's filter.
MOST_RANGES = 100
COMMIT = "field_id long, attempt string, number long, name string, band string, mjd double, n_detections long, n_with_sky long, n_matched long, n_new_objects long, manifest string"
FOUNDER = "object_id long, ra double, dec double, healpix long, field_id long, attempt string, coarse long"


@dataclass
class Store:
    """The tables below ``path``; ``radius`` is the match radius in arcseconds."""

    spark: SparkSession
    path: str
    radius: float = 1.5

    # -- what has been committed ------------------------------------------------------------------------------
    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _has(self, name: str) -> bool:
        path, files = self._file(name)
        return files.exists(path)

    def fields(self) -> DataFrame:
        """One row a committed field, in the order of ingestion (``number``)."""
        if not self._has("commits"):
            return self.spark.createDataFrame([], COMMIT)
        return self.spark.read.schema(COMMIT).json(f"{self.path}/commits")

    def _commit(self, row: dict) -> bool:
        """Whether this attempt's row became the field's: the rename fails if another was first."""
        final, files = self._file(f"commits/{row['field_id']}.json")
        draft, _ = self._file(f"drafts/{row['attempt']}.json")
        files.mkdirs(final.getParent())
        out = files.create(draft)
        out.write((json.dumps(row) + "\n").encode())
        out.close()
        return not files.exists(final) and files.rename(draft, final)

    def _committed(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.fields().select("field_id", "attempt"), ["field_id", "attempt"], "left_semi")

    def founders(self, coarse: list[int] | None = None) -> DataFrame:
        """object_id, ra, dec, healpix, field_id of all objects, or of those in some coarse pixels, whose folders alone are read."""
        if not self._has("founders"):
            return self.spark.createDataFrame([], FOUNDER).drop("attempt", "coarse")
        rows = self.spark.read.schema(FOUNDER).parquet(f"{self.path}/founders")
        if coarse is not None:
            rows = rows.filter(F.col("coarse").isin(coarse))
        return self._committed(rows).drop("attempt", "coarse")

    def detections(self) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/detections")
        return self._committed(rows.withColumn("field_id", F.col("field_id").cast("long")))

    # -- ingest -----------------------------------------------------------------------------------------------
    def _placed(self, rows: DataFrame) -> DataFrame:
        """Rows with their fine pixel; numbers that are not finite as null."""
        rows = rows.withColumns({f.name: finite(F.col(f.name)) for f in rows.schema if f.dataType.typeName() in ("double", "float")})
        has_sky = F.col("ra").isNotNull() & F.col("dec").isNotNull()
        return rows.withColumn("healpix", F.when(has_sky, healpix(FINE, F.col("ra"), F.col("dec"))))

    def _touched(self, rows: DataFrame) -> DataFrame:
        """``coarse``: the coarse pixels in which an object near one of the rows may lie, found from the squares of GRID degrees they fall into."""
        at = lambda c: (F.floor(F.col(c) / GRID) + 0.5) * GRID
        squares = rows.filter("healpix IS NOT NULL").select(at("ra").alias("ra"), at("dec").alias("dec")).distinct()
        squares = squares.withColumn("dec", F.least(F.greatest("dec", F.lit(-90.0)), F.lit(90.0)))
        reach = 2 * (self.radius / 3600 + GRID)
        across = reach / F.greatest(F.cos(F.radians("dec")), F.lit(1e-6))
        point = lambda ra, dec: F.struct(ra.alias("ra"), dec.alias("dec"))
        corners = [point(F.col("ra") + i * across, F.least(F.greatest(F.col("dec") + j * reach, F.lit(-90.0)), F.lit(90.0))) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        # a circle about a pole passes through all of its quarters
        quarters = [point(F.col("ra") + t, F.col("dec")) for t in (0.0, 90.0, 180.0, 270.0)]
        around = F.when(F.abs("dec") + 2 * reach >= 90, F.array(*corners, *quarters)).otherwise(F.array(*corners))
        points = squares.select(F.explode(around).alias("p")).select("p.ra", "p.dec")
        return points.select(healpix(COARSE, F.col("ra"), F.col("dec")).alias("coarse")).distinct()

    def ingest(self, rows: DataFrame, field_id: int, mjd: float | None = None, band: str | None = None, name: str | None = None, manifest: dict | None = None, associate: bool = True) -> dict | None:
        """Store one field's rows (detection_id, ra, dec, ...) and link them; the field's report, None if it was there before.

        Numbers that are not finite become null; rows without a position are stored without a link. The nearest known
        object within the radius takes a detection (equal distances: the smaller id); every other one founds an object.
        """
        if self._has(f"commits/{field_id}.json"):
            return None
        for column, value, kind in (("mjd", mjd, "double"), ("band", band, "string")):
            if column not in rows.columns:
                rows = rows.withColumn(column, F.lit(value).cast(kind))
        return self._ingest(cut(self._placed(rows.drop("field_id"))), field_id, name, manifest, associate)

    def _ingest(self, rows: DataFrame, field_id: int, name: str | None, manifest: dict | None, associate: bool) -> dict | None:
        attempt = uuid.uuid4().hex
        place = f"{self.path}/detections/field_id={field_id}/attempt={attempt}"
        own = F.when(F.col("healpix").isNotNull(), F.col("detection_id")) if associate else F.lit(None).cast("long")
        linked = rows.withColumn("object_id", own)
        if associate and self._has("founders"):
            # at most MOST_FOLDERS pixels come to the driver
            touched = sorted(r[0] for r in self._touched(rows).limit(MOST_FOLDERS + 1).collect())
            known = self.founders(None if len(touched) > MOST_FOLDERS else touched).select(F.col("object_id").alias("id"), "ra", "dec")
            placed = rows.filter("healpix IS NOT NULL").select(F.col("detection_id").alias("id"), "ra", "dec")
            # both sides grow with the field and the sky, so none of them is broadcast
            links = nearest(sky_pairs(placed, known.hint("merge"), self.radius, settled=True)).select(F.col("a_id").alias("detection_id"), F.col("b_id").alias("known_id"))
            linked = linked.join(links.hint("merge"), "detection_id", "left").withColumn("object_id", F.coalesce("known_id", "object_id")).drop("known_id")
        founds = F.col("object_id") == F.col("detection_id")
        seen = Observation()
        linked = linked.observe(
            seen, F.count("*").alias("n_detections"), F.count("healpix").alias("n_with_sky"), F.count(F.when(~founds, 1)).alias("n_matched"),
            F.count(F.when(founds, 1)).alias("n_new_objects"), F.min("mjd").alias("mjd"), F.min("band").alias("band"),
        )
        linked.write.parquet(place)
        if associate:
            new = self.spark.read.schema(linked.schema).parquet(place).filter(founds)
            new = new.select("object_id", "ra", "dec", "healpix", F.lit(field_id).cast("long").alias("field_id"), F.lit(attempt).alias("attempt"), F.shiftright("healpix", _SHIFT).alias("coarse"))
            new.repartition("coarse").write.mode("append").partitionBy("coarse").parquet(f"{self.path}/founders")
        before = len(self._file("commits")[1].listStatus(self._file("commits")[0])) if self._has("commits") else 0
        report = {"field_id": field_id, "attempt": attempt, "number": before + 1, "name": name, "manifest": None if manifest is None else json.dumps(manifest), **seen.get}
        return report if self._commit(report) else None

    def ingest_batch(self, batch: DataFrame, _number: int = 0) -> None:
        """All fields of a batch (rows with field_id, mjd, band) in the order of (first mjd, field_id); meant for ``foreachBatch``.

        The list of the batch's fields comes to the driver. Fields follow one another, since a field's detections may match objects
        that the one before has founded.
        """
        path = shared_folder(self.spark)
        placed = self._placed(batch)
        placed.repartition("field_id").write.partitionBy("field_id").parquet(path)
        placed = self.spark.read.schema(placed.schema).parquet(path)
        order = placed.groupBy("field_id").agg(F.min("mjd").alias("mjd")).collect()
        for row in sorted(order, key=lambda r: (r.mjd is not None, r.mjd, r.field_id)):
            if not self._has(f"commits/{row.field_id}.json"):
                self._ingest(placed.filter(F.col("field_id") == row.field_id).drop("field_id"), row.field_id, f"field {row.field_id}", None, True)

    def ingest_stream(self, stream: DataFrame, checkpoint: str) -> None:
        """Ingest what a file stream holds now. A repeated batch finds its fields committed."""
        query = stream.writeStream.foreachBatch(self.ingest_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        if query.exception():
            raise query.exception()

    # -- reads ------------------------------------------------------------------------------------------------
    def counts(self) -> DataFrame:
        """One row: the numbers of fields, detections and objects, from the commits alone."""
        total = [F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("n_detections", "detections"), ("n_new_objects", "objects"))]
        return self.fields().agg(F.count("*").alias("fields"), *total)

    def objects(self) -> DataFrame:
        """object_id, ra, dec, healpix, n_detections, first_mjd, last_mjd, bands (in order of ingestion), founded_by."""
        seen = self.detections().filter("object_id IS NOT NULL").join(self.fields().select("field_id", "number"), "field_id")
        per_band = seen.groupBy("object_id", "band").agg(F.count("*").alias("n"), F.min("mjd").alias("first"), F.max("mjd").alias("last"), F.min("number").alias("number"))
        bands = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("band").isNotNull(), F.struct("number", "band")))), lambda b: b["band"]), ",")
        whole = per_band.groupBy("object_id").agg(F.sum("n").alias("n_detections"), F.min("first").alias("first_mjd"), F.max("last").alias("last_mjd"), bands.alias("bands"))
        return self.founders().withColumnRenamed("field_id", "founded_by").join(whole.hint("merge"), "object_id").select("object_id", "ra", "dec", "healpix", *whole.columns[1:], "founded_by")

    def history(self, object_id: int) -> DataFrame:
        """Every detection of an object with its field's name, in time order."""
        rows = self.detections().filter(F.col("object_id") == object_id)
        return rows.join(self.fields().select("field_id", F.col("name").alias("field_name")), "field_id").orderBy("mjd", "detection_id")

    def light_curve(self, object_id: int, band: str | None = None) -> DataFrame:
        rows = self.history(object_id).filter("mjd IS NOT NULL AND flux IS NOT NULL")
        return (rows if band is None else rows.filter(F.col("band") == band)).select("mjd", "flux", "flux_err")

    def field_rows(self, field_id: int) -> DataFrame:
        """One field's detections; only its folder is read."""
        return self.detections().filter(F.col("field_id") == field_id).orderBy("detection_id")

    def cone(self, ra: float, dec: float, radius_arcsec: float, table: str = "detections", limit: int | None = None) -> DataFrame:
        """Rows of detections or objects within a cone, nearest first, with ``separation_arcsec``.

        The pixels of a size like the cone's that it touches become ranges of the stored index, which reach the scan.
        """
        if table not in ("detections", "objects"):
            raise ValueError("table must be 'detections' or 'objects'")
        nside, degrees = COARSE, radius_arcsec / 3600
        while nside < FINE and math.degrees(math.sqrt(4 * math.pi / 12)) / nside > max(degrees, 1e-9) / 2:
            nside *= 2
        shift = 2 * (FINE.bit_length() - nside.bit_length())
        pixels = sorted(r.pixel for r in cone_cover(self.spark, ra, dec, degrees, nside).collect())
        ranges: list[list[int]] = []
        for p in pixels:
            if ranges and ranges[-1][1] == (p << shift) - 1:
                ranges[-1][1] = ((p + 1) << shift) - 1
            else:
                ranges.append([p << shift, ((p + 1) << shift) - 1])
        step = -(-len(ranges) // MOST_RANGES) or 1  # neighbouring ranges as one, where there are many
        ranges = [[part[0][0], part[-1][1]] for part in (ranges[i : i + step] for i in range(0, len(ranges), step))]
        inside: Column = F.lit(False)
        for low, high in ranges:
            inside = inside | F.col("healpix").between(low, high)
        rows = (self.detections() if table == "detections" else self.objects()).filter(inside)
        rows = rows.withColumn("separation_arcsec", 3600 * separation(F.col("ra"), F.col("dec"), F.lit(float(ra)), F.lit(float(dec)))).filter(F.col("separation_arcsec") <= radius_arcsec)
        rows = rows.orderBy("separation_arcsec", *(["detection_id"] if table == "detections" else ["object_id"]))
        return rows if limit is None else rows.limit(limit)

    def objects_with_history(self, least: int = 2, limit: int | None = None) -> DataFrame:
        rows = self.objects().filter(F.col("n_detections") >= least).orderBy(F.desc("n_detections"), "object_id")
        return rows if limit is None else rows.limit(limit)
