"""Rows that must not be lost: null types, null coordinates; weights inside complete graphs."""

import numpy as np

from sojourn.functions import kernels
from sojourn.operators import places, venues


def test_a_venue_with_a_null_type_stays(spark):
    rows = [("a", None, "food"), ("b", "Parking Lots", None), ("c", "Bakery", "food")]
    kept = venues.exclude_poi(spark.createDataFrame(rows, "poi_id string, sub_category string, category string"))
    assert sorted(r["poi_id"] for r in kept.collect()) == ["a", "c"]


def test_rows_without_coordinates_keep_a_label(spark):
    rows = [(1, 10.0, 20.0), (2, None, 20.0), (3, 10.0, 20.0)]
    found = places.cluster_points(spark.createDataFrame(rows, "id long, latitude double, longitude double"))
    labels = {r["id"]: r["loc"] for r in found.collect()}
    assert len(labels) == 3 and labels[2] == -1 and labels[1] == labels[3] != -1


def test_two_tight_pairs_are_two_places_when_weighted():
    lat = np.array([0.0, 1e-6, 1.8e-4, 1.81e-4])
    lon = np.zeros(4)
    plain = kernels.place_labels(lat, lon, np.ones(4), 30.0)
    tight = kernels.place_labels(lat, lon, np.ones(4), 30.0, weighted=True)
    assert len(set(plain.tolist())) == 1
    assert tight[0] == tight[1] != tight[2] == tight[3]
