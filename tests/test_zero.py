"""No rule divides by zero: rows whose times, distances and counts are 0, under the whole catalogue."""

from datetime import date

from test_feed import BASE

from timetide.plans.config import Config
from timetide.plans.engine import Run
from timetide.sources.feed import from_texts

FILES = {
    "stop_times.txt": "trip_id,arrival_time,departure_time,stop_id,stop_sequence,shape_dist_traveled\nnoon,10:00:00,10:00:00,pier_n,1,0\nnoon,10:00:00,10:00:00,pier_s,2,0\nnoon,10:00:00,10:00:00,pier_s,3,0\nnight,00:00:00,00:00:00,pier_n,0,0\nshore,09:00:00,09:00:00,pier_s,1,0\nshore,09:00:00,09:00:00,pier_s,2,0\n",
    "pathways.txt": "pathway_id,from_stop_id,to_stop_id,pathway_mode,is_bidirectional,length,traversal_time,stair_count,max_slope,min_width\nw,pier_n,pier_s,1,0,10,0,0,0,0\n",
    "frequencies.txt": "trip_id,start_time,end_time,headway_secs,exact_times\nnoon,10:00:00,11:00:00,0,1\nnoon,11:00:00,11:00:00,0,0\n",
    "transfers.txt": "from_stop_id,to_stop_id,transfer_type,min_transfer_time\npier_n,pier_s,2,0\npier_s,pier_s,2,0\n",
    "shapes.txt": "shape_id,shape_pt_lat,shape_pt_lon,shape_pt_sequence,shape_dist_traveled\na,47.5,9.2,0,0\na,47.5,9.2,1,0\na,47.5,9.2,2,0\n",
    "fare_attributes.txt": "fare_id,price,currency_type,payment_method,transfers,transfer_duration\nf,0,CHF,0,0,0\n",
}


def test_zeros(spark):
    run = Run(from_texts(spark, BASE | FILES), Config(today=date(2026, 5, 15)))
    found = {r.rule_id for r in run.notices().collect()}
    assert {"STM_012", "FRQ_008", "PTH_007"} <= found
    run.close()
