"""Streams give what the same operators give on tables."""

import numpy as np

from pixelframe.sources import images
from pixelframe.streaming import frames as s


def test_frames_stream(spark, tmp_path):
    made = images.from_arrays(spark, [np.full((2, 3, 1), k, np.uint8) for k in (4, 9)], "set")
    made.write.parquet(str(tmp_path / "in"))
    stream = s.frame_means(s.read_frames(spark, str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("means").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["mean"] for r in spark.table("means").collect()) == [4.0, 9.0]
