from __future__ import annotations

from pyspark.sql import functions as F

from frameloom.operators import validate
from frameloom.plans import document_queries as dq
from frameloom.sources import timelines as documents

#: One change of a document's text, and the rule that it must break at least.
FAULTS = {
    "none": ("^x", "", ""),
    "detector too small": (r'"roi":\{"x":0,"y":0,"width":64', '"roi":{"x":0,"y":0,"width":63', "V3.region"),
    "mask leaves nothing": (r'"ignore_masks":\[\]', '"ignore_masks":[{"x":0,"y":0,"width":64,"height":48}]', "V3.region"),
    "mask leaves too little": (r'"ignore_masks":\[\]', '"ignore_masks":[{"x":0,"y":0,"width":62,"height":48}]', "V3.region"),
    "mask leaves enough": (r'"ignore_masks":\[\]', '"ignore_masks":[{"x":0,"y":0,"width":32,"height":48}]', ""),
    "algorithm": (r'"algorithm":"spatial-groups-v1"', '"algorithm":"other"', "V5.observation"),
    "width": (r'"image_max_width":320', '"image_max_width":640', "V5.observation"),
    "dilation": (r'"mask_dilation_px":1', '"mask_dilation_px":2', "V5.observation"),
    **{c: (rf'"{c}":[0-9]+', f'"{c}":256', "V5.observation") for c in ("pixel_delta", "edge_delta")},
    **{c: (rf'"{c}":[0-9]+', f'"{c}":0', "V5.observation") for c in ("tile_size", "support_samples", "overlay_missing_edges")},
    **{c: (rf'"{c}":[0-9.]+', f'"{c}":0.0', "V5.observation") for c in ("cell_changed_fraction", "core_edge_fraction", "overlay_fraction", "transient_penalty")},
    **{f"{c} over 1": (rf'"spatial":\{{(.*?)"{c}":[0-9.]+', f'"spatial":{{$1"{c}":1.5', "V5.observation") for c in ("changed_fraction", "cell_fraction")},
}


def test_geometry_and_detector_of_documents_are_checked(spark, smoke_dir):
    base = dq.detailed(spark, smoke_dir).limit(1)
    rows = base.select(F.explode(F.array(*(F.struct(F.lit(n).alias("fault"), F.regexp_replace("document", find, put).alias("document")) for n, (find, put, _) in FAULTS.items()))).alias("m")).select("m.*").withColumnRenamed("fault", "name")
    good, bad = documents.parse(rows)
    assert bad.select("name", "fault").collect() == []
    got = {r["name"]: r["broken"] for r in validate.violations(good).select("name", "broken").collect()}
    assert set(got) == set(FAULTS)
    wrong = {n: got[n] for n, (_, _, said) in FAULTS.items() if (said not in got[n] if said else got[n])}
    assert wrong == {}
