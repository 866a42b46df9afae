"""Nearest-neighbour and spatial joins for large point tables on Spark."""

# ruff: noqa: F401

from geonear.functions.codec import decode_wkb, decode_wkt, encode_wkb, encode_wkt
from geonear.functions.geodesy import geodesic_distance, geodesic_inverse, reproject_points
from geonear.functions.geometry import bbox_within, distance, distance_sq, dwithin, point, with_srid
from geonear.functions.hexgrid import hex_cell, hex_disk
from geonear.functions.sql import register_sql_functions
from geonear.operators.compare import check, compare_methods, diff_inner
from geonear.operators.geodesic import nearest_geodesic
from geonear.operators.grouping import first_per_key, group_colocated, last_per_key, number_keys
from geonear.operators.hexjoin import nearest_in_hex_disk
from geonear.operators.knn import (
    candidate_pairs,
    candidate_places,
    knn_join,
    knn_join_top1,
    knn_rounded_first,
    nearest,
    nearest_all_ties,
    nearest_all_vs_all,
    nearest_by_window,
    nearest_distinct_on,
    nearest_first_of_ties,
    nearest_in_square,
    nearest_lateral,
    nearest_sort_dedupe,
    neighbour_lists,
)
from geonear.operators.leaves import Leaves, build_leaves, search_leaves
from geonear.operators.pairs import bbox_join, dwithin_join
from geonear.operators.polygons import Polygons, cut_polygons, points_in_polygons, ring_edges
from geonear.operators.tiles import Tiles, build_tiles
from geonear.plans.prepare import load_serving_table, prepare
from geonear.session import materialize
from geonear.sources.files import (
    append_by_name,
    create_keyed_table,
    curve_code,
    export_points_psv,
    insert_into_keyed_table,
    insert_new_keys,
    keys_to_insert,
    read_points_csv,
    read_ordered_csv,
    read_points_jdbc,
    read_points_orc,
    read_points_psv,
    read_result_csv,
    save_result_table,
    write_points_orc,
    write_result_csv,
)
from geonear.sources.geopackage import polygon_edges, read_geopackage, register_geopackage
