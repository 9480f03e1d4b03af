"""Checks that are queries: groups, orders, intervals, distances, reachability, whole-feed figures.

Key: `rule marks file field needed-views...`; the SQL gives `id` and `seen`. Views are the tables as text, and the typed
ones of timetide.plans.views (st, tr, active, spans, ran, calls, legs, pts, places). Thresholds stand by their names in Config.
"""

from __future__ import annotations

QUERIES = {
    # The archive as a whole
    "ARC_020 LQF1 - -": "SELECT NULL AS id, concat_ws(', ', IF(infos = 0, 'feed_info.txt', NULL), IF(points = 0, 'shapes.txt', NULL)) AS seen FROM (SELECT (SELECT count(*) FROM feed_info) AS infos, (SELECT count(*) FROM shapes) AS points, (SELECT count(*) FROM stop_times WHERE blank(start_pickup_drop_off_window)) AS fixed, (SELECT count(*) FROM routes WHERE oneof(continuous_pickup, 0, 2, 3) OR oneof(continuous_drop_off, 0, 2, 3)) AS continuous) WHERE infos = 0 OR (points = 0 AND fixed > 0 AND continuous = 0)",
    # One summary a file of the keys that come twice; `file` is a column
    "DQ_021 HSL1 * -": "SELECT 'stops.txt' AS file, stop_id AS id, count(*) AS seen, min(line) AS line FROM stops WHERE given(stop_id) GROUP BY stop_id HAVING count(*) > 1 UNION ALL SELECT 'routes.txt' AS file, route_id AS id, count(*) AS seen, min(line) AS line FROM routes WHERE given(route_id) GROUP BY route_id HAVING count(*) > 1 UNION ALL SELECT 'trips.txt' AS file, trip_id AS id, count(*) AS seen, min(line) AS line FROM trips WHERE given(trip_id) GROUP BY trip_id HAVING count(*) > 1 UNION ALL SELECT 'route_networks.txt' AS file, route_id AS id, count(*) AS seen, min(line) AS line FROM route_networks WHERE given(route_id) GROUP BY route_id HAVING count(*) > 1 UNION ALL SELECT 'attributions.txt' AS file, attribution_id AS id, count(*) AS seen, min(line) AS line FROM attributions WHERE given(attribution_id) GROUP BY attribution_id HAVING count(*) > 1",
    # Agencies
    "AGN_005 MSF1 agency.txt agency_timezone agency": "SELECT NULL AS id, count(DISTINCT agency_timezone) AS seen FROM agency HAVING count(*) >= 2 AND count(DISTINCT agency_timezone) > 1",
    "AGN_011 CSF1 agency.txt agency_id agency routes": "SELECT NULL AS id, count(*) AS seen FROM routes WHERE blank(agency_id) AND (SELECT count(*) FROM agency) >= 2 HAVING count(*) > 0",
    "AGN_014 CSE1 agency.txt agency_id agency": "SELECT agency_name AS id, NULL AS seen FROM agency WHERE blank(agency_id) AND (SELECT count(*) FROM agency) > 1",
    "AGN_017 LIF1 agency.txt agency_lang agency": "SELECT NULL AS id, count(DISTINCT lower(agency_lang)) AS seen FROM agency WHERE given(agency_lang) HAVING count(DISTINCT lower(agency_lang)) > 1",
    "AGN_018 IQF10 agency.txt agency_id agency": "SELECT NULL AS id, count(*) AS seen FROM agency HAVING count(*) = 1 AND bool_and(blank(agency_id))",
    "AGN_013 LIE1 agency.txt agency_lang agency feed_info": "SELECT agency_id AS id, agency_lang AS seen FROM agency WHERE given(agency_lang) AND lower(agency_lang) <> (SELECT lower(min_by(feed_lang, line)) FROM feed_info WHERE given(feed_lang))",
    "DQ_012 LQF1 agency.txt agency_id agency routes": "SELECT NULL AS id, count(*) AS seen FROM agency HAVING count(*) > 5 AND (SELECT count(*) FROM routes WHERE given(agency_id)) = 0",
    "FIN_013 IQF1 fare_attributes.txt agency_id agency fare_attributes": "SELECT NULL AS id, count(*) AS seen FROM fare_attributes WHERE blank(agency_id) AND (SELECT count(*) FROM agency) = 1 HAVING count(*) > 0",
    "FIN_015 MQL1 feed_info.txt - feed_info": "SELECT NULL AS id, count(*) AS seen FROM feed_info HAVING count(*) > 1",
    # Stops
    "STP_010 HSE1 stops.txt parent_station stops": "SELECT c.stop_id AS id, p.stop_id AS seen FROM stops c JOIN stops p ON c.parent_station = p.stop_id WHERE NOT oneof(c.location_type, 4) AND NOT oneof(p.location_type, 1)",
    "STP_012 CSE1 stop_times.txt stop_id stops stop_times": "SELECT stop_id AS id, location_type AS seen FROM stops WHERE oneof(location_type, 1, 2, 3, 4) AND stop_id IN (SELECT stop_id FROM stop_times)",
    "STP_016 MQE2 stops.txt stop_lat near places": "SELECT a AS id, b AS seen FROM near WHERE metres = 0",
    "STP_017 LQE1 stops.txt stop_lat near places": "SELECT a AS id, b AS seen FROM near WHERE metres > 0 AND metres < stop_too_close_m",
    "STP_018 CSF1 stops.txt stop_id stops": "SELECT NULL AS id, count(*) AS seen FROM stops HAVING count(*) = 0",
    "STP_021 HQE2 stops.txt parent_station stops": "SELECT c.stop_id AS id, p.stop_id AS seen FROM stops c JOIN stops p ON c.parent_station = p.stop_id WHERE oneof(c.location_type, 4) AND NOT (blank(p.location_type) OR oneof(p.location_type, 0))",
    "STP_029 MQE2 stops.txt stop_lat places": "SELECT c.stop_id AS id, round(km(c.lat, c.lon, p.lat, p.lon) * 1000, 1) AS seen FROM places c JOIN places p ON c.parent_station = p.stop_id WHERE km(c.lat, c.lon, p.lat, p.lon) * 1000 > stop_far_from_parent_m",
    "STP_030 MQE1 stops.txt parent_station stops": "SELECT stop_id AS id, NULL AS seen FROM stops s WHERE oneof(location_type, 1) AND NOT EXISTS (SELECT 1 FROM stops c WHERE c.parent_station = s.stop_id)",
    "STP_034 LQE1 stops.txt stop_url stops agency": "SELECT stop_id AS id, stop_url AS seen FROM stops WHERE given(stop_url) AND regexp_replace(lower(stop_url), '^https?://|/+$', '') IN (SELECT regexp_replace(lower(agency_url), '^https?://|/+$', '') FROM agency WHERE given(agency_url))",
    "STP_035 LQE1 stops.txt stop_url stops routes": "SELECT stop_id AS id, stop_url AS seen FROM stops WHERE given(stop_url) AND regexp_replace(lower(stop_url), '^https?://|/+$', '') IN (SELECT regexp_replace(lower(route_url), '^https?://|/+$', '') FROM routes WHERE given(route_url))",
    "STP_037 IQF1 stops.txt wheelchair_boarding stops": "SELECT NULL AS id, sum(unset) AS seen FROM (SELECT IF(blank(wheelchair_boarding) OR oneof(wheelchair_boarding, 0), 1, 0) AS unset FROM stops WHERE blank(location_type) OR oneof(location_type, 0)) HAVING sum(unset) > 0 AND sum(unset) < count(*)",
    "STP_038 IQF1 stops.txt wheelchair_boarding stops": "SELECT NULL AS id, sum(unset) AS seen FROM (SELECT IF(blank(wheelchair_boarding) OR oneof(wheelchair_boarding, 0), 1, 0) AS unset FROM stops WHERE blank(location_type) OR oneof(location_type, 0)) HAVING sum(unset) = count(*) AND count(*) > 0",
    "STP_039 LQE10 stops.txt stop_code stops": "SELECT stop_id AS id, stop_code AS seen FROM (SELECT *, first_value(stop_id) OVER (PARTITION BY stop_code ORDER BY line) AS holder FROM stops WHERE given(stop_code)) WHERE holder <> stop_id",
    "STP_041 LQE1 stops.txt stop_name stops": "SELECT c.stop_id AS id, c.stop_name AS seen FROM stops c JOIN stops p ON c.parent_station = p.stop_id WHERE stop_name_best_practices AND NOT contains(lower(c.stop_name), lower(p.stop_name))",
    "GEO_002 HAE2 stops.txt stop_lat places": "WITH c AS (SELECT median(lat) AS lat, median(lon) AS lon, count(*) AS n FROM places WHERE NOT (abs(lat) < 0.1 AND abs(lon) < 0.1)), d AS (SELECT stop_id, n, km(p.lat, p.lon, c.lat, c.lon) AS away FROM places p CROSS JOIN c WHERE NOT (abs(p.lat) < 0.1 AND abs(p.lon) < 0.1)), l AS (SELECT IF(max(n) >= 100, greatest(200, 3 * percentile(away, 0.99)), 200) AS most FROM d) SELECT stop_id AS id, round(away, 1) AS seen FROM d CROSS JOIN l WHERE away > most",
    "GEO_013 IAF2 stops.txt stop_lat places": "SELECT NULL AS id, concat_ws(' ', min(lat), min(lon), max(lat), max(lon)) AS seen FROM places HAVING count(*) > 0",
    "GEO_014 IAF1 stops.txt stop_lat places": "SELECT NULL AS id, round(km(min(lat), min(lon), max(lat), max(lon)), 1) AS seen FROM places HAVING km(min(lat), min(lon), max(lat), max(lon)) > 500",
    "GEO_018 HAF2 stops.txt stop_lat places": "SELECT NULL AS id, count(*) AS seen FROM places HAVING count(*) >= 3 AND km(min(lat), min(lon), max(lat), max(lon)) < 0.2",
    "GEO_021 HAF2 stops.txt stop_lat places": "WITH c AS (SELECT count(*) AS n FROM places WHERE location_type = 0 GROUP BY round(lat, 6), round(lon, 6)) SELECT NULL AS id, sum(IF(n > 1, n, 0)) AS seen FROM c HAVING sum(n) >= 5 AND sum(IF(n > 1, n, 0)) >= 0.3 * sum(n)",
    "DQ_005c HQF2 stops.txt stop_lat stops": "SELECT NULL AS id, sum(IF(num(stop_lat) IS NULL OR num(stop_lon) IS NULL, 1, 0)) AS seen FROM stops HAVING sum(IF(num(stop_lat) IS NULL OR num(stop_lon) IS NULL, 1, 0)) > 0.5 * count(*)",
    "DQ_011 LQF1 stops.txt stop_id stops": "SELECT NULL AS id, count(*) AS seen FROM stops HAVING count(*) = 1",
    "DQ_022 HQF2 stops.txt stop_name stops": "WITH c AS (SELECT stop_name, count(*) AS n FROM stops WHERE given(stop_name) GROUP BY stop_name) SELECT NULL AS id, max(n) AS seen FROM c HAVING sum(n) >= 5 AND max(n) > 0.8 * sum(n)",
    # Routes
    "RTS_008 MQE1 routes.txt route_text_color routes": "WITH c AS (SELECT route_id, transform(array(1, 3, 5), i -> conv(substr(route_color, i, 2), 16, 10) / 255D) AS a, transform(array(1, 3, 5), i -> conv(substr(route_text_color, i, 2), 16, 10) / 255D) AS b FROM routes WHERE colour(route_color) AND colour(route_text_color)), l AS (SELECT route_id, transform(a, x -> IF(x <= 0.03928, x / 12.92, pow((x + 0.055) / 1.055, 2.4))) AS a, transform(b, x -> IF(x <= 0.03928, x / 12.92, pow((x + 0.055) / 1.055, 2.4))) AS b FROM c), y AS (SELECT route_id, 0.2126 * a[0] + 0.7152 * a[1] + 0.0722 * a[2] AS a, 0.2126 * b[0] + 0.7152 * b[1] + 0.0722 * b[2] AS b FROM l) SELECT route_id AS id, round((greatest(a, b) + 0.05) / (least(a, b) + 0.05), 2) AS seen FROM y WHERE (greatest(a, b) + 0.05) / (least(a, b) + 0.05) < 3.0",
    "RTS_016 LQE2 routes.txt route_id tr active": "SELECT route_id AS id, NULL AS seen FROM tr LEFT JOIN (SELECT DISTINCT service_id AS s FROM active) ON s = service_id GROUP BY route_id HAVING count(s) = 0",
    "RTS_017 IQE20 trips.txt shape_id tr": "SELECT route_id AS id, NULL AS seen FROM tr GROUP BY route_id HAVING count(shape_id) = 0",
    "RTS_019 MQR1 routes.txt route_short_name routes": "SELECT route_id AS id, n AS seen FROM (SELECT route_id, route_short_name, route_long_name, count(*) OVER (PARTITION BY lower(route_short_name), lower(route_long_name)) AS n FROM routes WHERE NOT (blank(route_short_name) AND blank(route_long_name))) WHERE n >= 2",
    "RTS_020 IQE1 routes.txt route_url routes agency": "SELECT route_id AS id, route_url AS seen FROM routes r JOIN agency a ON (r.agency_id = a.agency_id OR blank(r.agency_id)) AND r.route_url = a.agency_url WHERE given(r.route_url)",
    "RTS_026 IQR1 routes.txt route_short_name routes": "SELECT min_by(route_id, line) AS id, lower(route_short_name) AS seen FROM routes WHERE given(route_short_name) GROUP BY lower(route_short_name) HAVING count(*) >= 2 AND min(lower(route_long_name)) <> max(lower(route_long_name))",
    "RTS_027 IQR1 routes.txt route_long_name routes": "SELECT min_by(route_id, line) AS id, lower(route_long_name) AS seen FROM routes WHERE given(route_long_name) GROUP BY lower(route_long_name) HAVING count(*) >= 2 AND min(lower(route_short_name)) <> max(lower(route_short_name))",
    # Trips
    "TRP_012 LQE1 trips.txt direction_id tr": "SELECT route_id AS id, NULL AS seen FROM tr GROUP BY route_id HAVING min(direction_id) <> max(direction_id) AND count(direction_id) < count(*)",
    "TRP_013 IAE10 trips.txt trip_id tr": "SELECT route_id AS id, 1 AS seen FROM tr GROUP BY route_id HAVING count(*) = 1",
    "TRP_015 LQF1 trips.txt block_id tr": "SELECT NULL AS id, count(*) AS seen FROM (SELECT count(*) AS n FROM tr WHERE block_id IS NOT NULL GROUP BY block_id, service_id) HAVING max(n) = 1",
    "TRP_017 MQE1 frequencies.txt trip_id frequencies trips stop_times": "SELECT DISTINCT trip_id AS id, NULL AS seen FROM frequencies WHERE trip_id IN (SELECT trip_id FROM trips) AND NOT EXISTS (SELECT 1 FROM stop_times s WHERE s.trip_id = frequencies.trip_id)",
    "TRP_022 HIE3 trips.txt block_id tr spans": "SELECT trip_id AS id, block_id AS seen FROM (SELECT trip_id, block_id, first_dep, max(last_arr) OVER (PARTITION BY block_id, service_id ORDER BY first_dep, trip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy FROM ran WHERE block_id IS NOT NULL) WHERE first_dep < busy",
    "TRP_023 LQF1 calendar.txt start_date active trips": "SELECT NULL AS id, NULL AS seen FROM active WHERE date >= today AND date < date_add(today, 7) HAVING count(*) = 0",
    "TRP_024 LQE1 trips.txt block_id tr": "SELECT block_id AS id, count(DISTINCT mode) AS seen FROM (SELECT block_id, CASE WHEN route_type BETWEEN 200 AND 299 OR route_type BETWEEN 700 AND 799 THEN 3 WHEN route_type BETWEEN 100 AND 199 THEN 2 WHEN route_type BETWEEN 400 AND 404 THEN 1 WHEN route_type = 405 THEN 12 WHEN route_type BETWEEN 900 AND 999 THEN 0 WHEN route_type = 800 THEN 11 WHEN route_type BETWEEN 1000 AND 1021 OR route_type = 1200 THEN 4 WHEN route_type BETWEEN 1300 AND 1307 THEN 6 WHEN route_type = 1400 THEN 7 ELSE route_type END AS mode FROM tr WHERE block_id IS NOT NULL) GROUP BY block_id HAVING count(DISTINCT mode) > 1",
    "TRP_025 IQF1 trips.txt wheelchair_accessible trips": "SELECT NULL AS id, round(avg(IF(blank(wheelchair_accessible) OR oneof(wheelchair_accessible, 0), 1, 0)), 4) AS seen FROM trips HAVING avg(IF(blank(wheelchair_accessible) OR oneof(wheelchair_accessible, 0), 1, 0)) > 0.8 AND avg(IF(blank(wheelchair_accessible) OR oneof(wheelchair_accessible, 0), 1, 0)) < 1",
    "TRP_026 MAE2 trips.txt service_id tr active": "SELECT trip_id AS id, service_id AS seen FROM tr WHERE service_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM active a WHERE a.service_id = tr.service_id)",
    "TRP_028 IQF1 trips.txt wheelchair_accessible trips": "SELECT NULL AS id, sum(unset) AS seen FROM (SELECT IF(blank(wheelchair_accessible) OR oneof(wheelchair_accessible, 0), 1, 0) AS unset FROM trips) HAVING sum(unset) > 0 AND sum(unset) < count(*)",
    "TRP_029 IQF1 trips.txt wheelchair_accessible trips": "SELECT NULL AS id, sum(unset) AS seen FROM (SELECT IF(blank(wheelchair_accessible) OR oneof(wheelchair_accessible, 0), 1, 0) AS unset FROM trips) HAVING sum(unset) = count(*) AND count(*) > 0",
    "RTS_028 HSE1 routes.txt continuous_pickup routes trips stop_times": "SELECT route_id AS id, IF(oneof(continuous_pickup, 0, 2, 3), continuous_pickup, continuous_drop_off) AS seen FROM routes WHERE (oneof(continuous_pickup, 0, 2, 3) OR oneof(continuous_drop_off, 0, 2, 3)) AND route_id IN (SELECT t.route_id FROM trips t JOIN stop_times s ON s.trip_id = t.trip_id WHERE given(s.start_pickup_drop_off_window) OR given(s.end_pickup_drop_off_window))",
    "TRP_019 HSE1 trips.txt shape_id trips routes stop_times": "SELECT trip_id AS id, route_id AS seen FROM trips t WHERE blank(shape_id) AND (EXISTS (SELECT 1 FROM routes r WHERE r.route_id = t.route_id AND (oneof(r.continuous_pickup, 0, 2, 3) OR oneof(r.continuous_drop_off, 0, 2, 3))) OR EXISTS (SELECT 1 FROM stop_times s WHERE s.trip_id = t.trip_id AND (oneof(s.continuous_pickup, 0, 2, 3) OR oneof(s.continuous_drop_off, 0, 2, 3))))",
    "TRP_021 IQE1 trips.txt bikes_allowed trips": "SELECT NULL AS id, count(*) AS seen FROM trips WHERE blank(bikes_allowed) OR oneof(bikes_allowed, 0) HAVING count(*) > 0",
    "DQ_005 HQF2 calendar.txt end_date active trips": "SELECT NULL AS id, NULL AS seen FROM active WHERE date >= today HAVING count(*) = 0 AND (SELECT count(*) FROM trips) > 0",
    "DQ_005b HQF2 stop_times.txt trip_id trips stop_times": "SELECT NULL AS id, count(*) AS seen FROM trips WHERE (SELECT count(*) FROM trips t JOIN stop_times s ON t.trip_id = s.trip_id) = 0 HAVING count(*) > 0",
    "DQ_006 HQF20 trips.txt shape_id tr": "SELECT NULL AS id, round(avg(IF(shape_id IS NULL, 1, 0)), 4) AS seen FROM tr HAVING avg(IF(shape_id IS NULL, 1, 0)) > 0.8",
    "DQ_009 IQF1 stop_times.txt trip_id trips stop_times": "SELECT NULL AS id, count(*) AS seen FROM trips WHERE (SELECT count(*) FROM stop_times) = 0 HAVING count(*) > 0",
    "DQ_013 IAF10 trips.txt trip_id trips": "SELECT NULL AS id, count(*) AS seen FROM trips HAVING count(*) BETWEEN 1 AND 2",
    "XFL_012 HQE2 routes.txt route_id tr stop_times": "SELECT route_id AS id, NULL AS seen FROM tr LEFT JOIN (SELECT DISTINCT trip_id AS t FROM stop_times) ON t = trip_id GROUP BY route_id HAVING count(t) = 0",
    "XFL_013 HQE2 trips.txt shape_id tr": "SELECT shape_id AS id, NULL AS seen FROM tr WHERE shape_id IS NOT NULL AND direction_id IN (0, 1) GROUP BY shape_id HAVING min(direction_id) <> max(direction_id)",
    # Stop times
    "STM_008 CIE2 stop_times.txt arrival_time st": "SELECT trip_id AS id, min(line) AS seen FROM st WHERE arr < reached GROUP BY trip_id",
    "STM_012 HIR2 stop_times.txt arrival_time legs": "SELECT trip_id AS id, round(try_divide(distance, arr - dep) * 3600, 1) AS seen FROM legs WHERE (arr > dep AND try_divide(distance, arr - dep) * 3600 > 700) OR (arr = dep AND arr % 60 = 0 AND distance > limit / 60)",
    "STM_014 HAE3 stop_times.txt arrival_time legs": "SELECT concat_ws('|', route_id, direction_id, stop_a, stop_b) AS id, round(max(try_divide(distance, arr - dep) * 3600), 1) AS seen FROM legs WHERE arr > dep AND try_divide(distance, arr - dep) * 3600 > limit AND try_divide(distance, arr - dep) * 3600 <= 700 GROUP BY route_id, direction_id, stop_a, stop_b",
    "STM_015 CSR2 stop_times.txt arrival_time st": "SELECT trip_id AS id, line AS seen FROM st WHERE nth = 1 AND arr_absent AND NOT window",
    "STM_016 CSR2 stop_times.txt arrival_time st": "SELECT trip_id AS id, line AS seen FROM st WHERE is_last AND arr_absent AND NOT window",
    "STM_017 MQR30 stop_times.txt shape_dist_traveled st tr": "SELECT trip_id AS id, count(*) AS seen FROM calls WHERE shape_id IS NOT NULL AND route_type <> 2 AND stop_id IS NOT NULL AND dist IS NULL GROUP BY trip_id",
    "STM_020 HQR3 stop_times.txt arrival_time legs": "SELECT trip_id AS id, round(max(distance) * 1000, 1) AS seen FROM legs WHERE arr = dep AND distance > 0.2 AND arr % 60 <> 0 GROUP BY trip_id",
    "STM_021 IAR30 stop_times.txt stop_id legs": "SELECT concat_ws('|', least(stop_a, stop_b), greatest(stop_a, stop_b)) AS id, count(*) AS seen FROM legs WHERE distance < 0.000001 AND stop_a <> stop_b GROUP BY 1",
    "STM_025 IAE2 stop_times.txt arrival_time legs": "SELECT concat_ws('|', route_id, direction_id, stop_a, stop_b) AS id, min(arr - dep) AS seen FROM legs WHERE arr - dep BETWEEN 1 AND 9 GROUP BY route_id, direction_id, stop_a, stop_b",
    "STM_026 IAR20 stop_times.txt stop_id legs": "SELECT trip_id AS id, round(max(distance), 1) AS seen FROM legs WHERE distance > IF(route_type = 2 OR route_type BETWEEN 100 AND 199, rail_stop_distance_km, 50D) GROUP BY trip_id",
    "STM_028 HAR2 stop_times.txt arrival_time spans tr": "SELECT trip_id AS id, last_arr - first_dep AS seen FROM ran WHERE last_arr - first_dep > 3600 * IF(route_type = 2 OR route_type BETWEEN 100 AND 199, max_trip_duration_hours_rail, max_trip_duration_hours)",
    "STM_029 MAR2 stop_times.txt arrival_time spans": "SELECT trip_id AS id, last_arr - first_dep AS seen FROM spans WHERE n > 1 AND last_arr - first_dep < min_trip_duration_sec",
    "STM_033 HIE2 stop_times.txt trip_id spans": "SELECT trip_id AS id, n AS seen FROM spans WHERE n = 1",
    "STM_035 IAR10 stop_times.txt stop_id legs": "SELECT concat_ws('|', route_id, stop_a) AS id, count(*) AS seen FROM legs WHERE stop_a = stop_b GROUP BY route_id, stop_a",
    "STM_036 IQF2 stop_times.txt stop_sequence st": "SELECT trip_id AS id, NULL AS seen FROM st GROUP BY trip_id HAVING bool_or(seq = seq_before OR line < line_before) OR max(line) - min(line) + 1 > count(*)",
    "STM_043 IAE1 stop_times.txt trip_id spans": "SELECT trip_id AS id, n AS seen FROM spans WHERE n > max_stops_per_trip",
    "STM_044 IAF1 stop_times.txt - stop_times": "SELECT NULL AS id, count(*) AS seen FROM stop_times HAVING count(*) > max_total_stop_times",
    "STM_045 IAE10 stop_times.txt departure_time st": "SELECT trip_id AS id, max(dep) AS seen FROM st GROUP BY trip_id HAVING max(dep) > (24 + IF(service_day_start_hour = 0, 2, service_day_start_hour)) * 3600",
    "STM_048 HSR1 stop_times.txt arrival_time st": "SELECT trip_id AS id, line AS seen FROM st WHERE raw_dep_before >= 72000 AND raw_arr < 14400",
    "STM_053 IAE2 stop_times.txt arrival_time st tr": "SELECT route_id AS id, max(held) AS seen FROM calls WHERE held >= 3 GROUP BY route_id",
    "STM_056 CSR1 stop_times.txt shape_dist_traveled st": "SELECT trip_id AS id, line AS seen FROM st WHERE CAST(dist AS FLOAT) <= CAST(dist_before AS FLOAT)",
    "STM_059 LQE1 stop_times.txt pickup_booking_rule_id stop_times booking_rules": "SELECT trip_id AS id, line AS seen FROM stop_times WHERE (oneof(pickup_type, 2) AND blank(pickup_booking_rule_id)) OR (oneof(drop_off_type, 2) AND blank(drop_off_booking_rule_id))",
    "PDW_006 MAE2 stop_times.txt start_pickup_drop_off_window stop_times": "SELECT trip_id AS id, line AS seen FROM (SELECT trip_id, line, sec(start_pickup_drop_off_window) AS a, max(sec(end_pickup_drop_off_window)) OVER (PARTITION BY trip_id, coalesce(location_id, location_group_id) ORDER BY sec(start_pickup_drop_off_window), line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy FROM stop_times WHERE given(location_id) OR given(location_group_id)) WHERE a < busy",
    "OPR_006 HAE3 stop_times.txt trip_id spans": "SELECT trip_id AS id, n AS seen FROM spans WHERE n < 2",
    "OPR_007 IAE30 stop_times.txt stop_id st": "SELECT trip_id AS id, stop_id AS seen FROM st GROUP BY trip_id, stop_id HAVING count(*) > 1 AND NOT (count(*) = 2 AND min(nth) = 1 AND bool_or(is_last)) AND max(nth) - min(nth) >= count(*)",
    "OPR_008 IAE30 stop_times.txt arrival_time legs": "SELECT trip_id AS id, count(*) AS seen FROM legs WHERE arr > dep AND try_divide(distance, arr - dep) * 3600 > limit GROUP BY trip_id HAVING count(*) > 1",
    "OPR_009 IAE2 stop_times.txt departure_time spans tr": "SELECT route_id AS id, count(*) AS seen FROM ran WHERE first_dep >= 82800 OR first_dep < service_day_start_hour * 3600 GROUP BY route_id",
    "OPR_017 MAE2 stop_times.txt trip_id legs": "SELECT trip_id AS id, round(sum(distance), 3) AS seen FROM legs GROUP BY trip_id HAVING sum(distance) > 0 AND sum(distance) < 0.1",
    "OPR_025 HAF2 stop_times.txt departure_time spans": "SELECT NULL AS id, round(avg(last_arr - first_dep), 1) AS seen FROM spans WHERE n > 1 HAVING count(*) >= 5 AND avg(last_arr - first_dep) < 60",
    # Service days
    "CAL_007 IAE2 calendar.txt start_date active": "SELECT service_id AS id, max(gap) AS seen FROM (SELECT service_id, date, datediff(date, lag(date) OVER (PARTITION BY service_id ORDER BY date)) - 1 AS gap FROM active) WHERE gap >= big_gap_days AND NOT (date_sub(date, gap) <= date_add(today, 30) AND date > today) GROUP BY service_id",
    "CAL_012 IAE2 calendar.txt start_date active": "SELECT service_id AS id, max(gap) AS seen FROM (SELECT service_id, date, datediff(date, lag(date) OVER (PARTITION BY service_id ORDER BY date)) - 1 AS gap FROM active) WHERE gap >= big_gap_days AND date_sub(date, gap) <= date_add(today, 30) AND date > today GROUP BY service_id",
    "CAL_009 IAF10 calendar.txt end_date calendar": "SELECT NULL AS id, max(day(end_date)) AS seen FROM calendar HAVING bool_and(day(end_date) < today)",
    "CAL_010 MAE2 calendar.txt service_id active": "SELECT service_id AS id, count(*) AS seen FROM active GROUP BY service_id HAVING count(*) BETWEEN 1 AND service_gap_days",
    "CAL_013 IAE1 calendar.txt end_date active": "SELECT service_id AS id, max(date) AS seen FROM active GROUP BY service_id HAVING max(date) < today",
    "CAL_014 IIE10 calendar.txt start_date active tr feed_info": "WITH f AS (SELECT min(day(feed_start_date)) AS a, max(day(feed_end_date)) AS b FROM feed_info) SELECT service_id AS id, NULL AS seen FROM active JOIN f ON date < a OR date > b WHERE service_id IN (SELECT service_id FROM tr) GROUP BY service_id",
    "CAL_015 IAF10 calendar.txt start_date active": "SELECT NULL AS id, min(date) AS seen FROM active HAVING min(date) > today",
    "CAL_016 IQF1 calendar.txt end_date active": "SELECT NULL AS id, max(date) AS seen FROM active HAVING datediff(max(date), today) > 730",
    "CAL_017 IAE10 calendar.txt start_date active": "SELECT service_id AS id, min(date) AS seen FROM active GROUP BY service_id HAVING min(date) > today",
    "CAL_018 IQE2 calendar.txt monday calendar calendar_dates": "SELECT service_id AS id, NULL AS seen FROM calendar c WHERE NOT (oneof(monday, 1) OR oneof(tuesday, 1) OR oneof(wednesday, 1) OR oneof(thursday, 1) OR oneof(friday, 1) OR oneof(saturday, 1) OR oneof(sunday, 1)) AND NOT EXISTS (SELECT 1 FROM calendar_dates d WHERE d.service_id = c.service_id AND oneof(d.exception_type, 1))",
    "CAL_021 IAE1 calendar.txt end_date active tr": "SELECT service_id AS id, max(date) AS seen FROM active WHERE service_id IN (SELECT service_id FROM tr) GROUP BY service_id HAVING min(date) <= today AND max(date) >= today AND count_if(date >= today AND date < date_add(today, upcoming_service_days)) = 0",
    "CAL_024 IAE10 calendar.txt end_date active tr": "SELECT service_id AS id, max(date) AS seen FROM active WHERE service_id IN (SELECT service_id FROM tr) GROUP BY service_id HAVING min(date) <= today AND count_if(date >= today AND date < date_add(today, 7)) = 0",
    "CLD_004 HQR2 calendar_dates.txt service_id calendar_dates tr": "SELECT DISTINCT service_id AS id, NULL AS seen FROM tr WHERE service_id IN (SELECT service_id FROM calendar_dates) AND NOT EXISTS (SELECT 1 FROM active a WHERE a.service_id = tr.service_id)",
    "CLD_006 IAR10 calendar_dates.txt date calendar_dates": "SELECT service_id AS id, count(*) AS seen FROM calendar_dates GROUP BY service_id HAVING count(*) > 60",
    "CLD_007 IAR1 calendar_dates.txt date calendar_dates calendar active": "WITH a AS (SELECT service_id, count(*) AS n FROM active GROUP BY service_id), e AS (SELECT service_id, count(*) AS n FROM calendar_dates WHERE service_id IN (SELECT service_id FROM calendar) GROUP BY service_id) SELECT e.service_id AS id, e.n AS seen FROM e JOIN a ON e.service_id = a.service_id WHERE e.n > a.n / 2",
    "XFL_006 MAE2 calendar_dates.txt exception_type calendar_dates": "SELECT service_id AS id, count(*) AS seen FROM calendar_dates d GROUP BY service_id HAVING count_if(oneof(exception_type, 1)) = 0 AND count_if(oneof(exception_type, 2)) > 0 AND bool_and(NOT in_calendar)".replace("FROM calendar_dates d", "FROM (SELECT d.*, EXISTS (SELECT 1 FROM calendar c WHERE c.service_id = d.service_id) AS in_calendar FROM calendar_dates d)"),
    "OPR_004 IAE1 calendar.txt saturday tr active": "SELECT route_id AS id, NULL AS seen FROM (SELECT DISTINCT route_id, service_id FROM tr) JOIN (SELECT service_id, bool_or(weekday(date) >= 5) AS weekend FROM active GROUP BY service_id) USING (service_id) GROUP BY route_id HAVING NOT bool_or(weekend)",
    "OPR_010 MAE2 trips.txt wheelchair_accessible trips": "SELECT route_id AS id, NULL AS seen FROM trips GROUP BY route_id HAVING (bool_or(oneof(wheelchair_accessible, 1)) AND bool_or(oneof(wheelchair_accessible, 2))) OR (bool_or(oneof(bikes_allowed, 1)) AND bool_or(oneof(bikes_allowed, 2)))",
    "OPR_011 HAE2 trips.txt service_id tr": "SELECT DISTINCT service_id AS id, NULL AS seen FROM tr WHERE service_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM active a WHERE a.service_id = tr.service_id)",
    "OPR_012 MAE2 calendar.txt start_date active tr": "SELECT service_id AS id, max(gap) AS seen FROM (SELECT service_id, datediff(date, lag(date) OVER (PARTITION BY service_id ORDER BY date)) - 1 AS gap FROM active) WHERE gap >= service_gap_days AND service_id IN (SELECT service_id FROM tr) GROUP BY service_id",
    "OPR_013 IAE2 trips.txt direction_id tr": "SELECT route_id AS id, NULL AS seen FROM tr WHERE direction_id IS NOT NULL GROUP BY route_id HAVING min(direction_id) = max(direction_id)",
    "OPR_015 IAE1 trips.txt shape_id tr": "SELECT route_id AS id, NULL AS seen FROM tr WHERE route_type <> 2 GROUP BY route_id HAVING min(shape_id) = max(shape_id) AND min(direction_id) <> max(direction_id)",
    "OPR_016 IAF1 calendar.txt service_id active trips": "SELECT NULL AS id, count(*) AS seen FROM trips WHERE (SELECT count(*) FROM active) = 0 HAVING count(*) > 0",
    "OPR_019 IAE2 calendar.txt service_id active tr": "SELECT route_id AS id, count(*) AS seen FROM (SELECT route_id, date FROM (SELECT DISTINCT route_id, service_id FROM tr) JOIN active USING (service_id) LEFT JOIN (SELECT service_id, day(date) AS date, 1 AS hit FROM calendar_dates) e USING (service_id, date) GROUP BY route_id, date HAVING count(DISTINCT service_id) > 1 AND count(hit) = 0) GROUP BY route_id",
    "OPR_020 LAE2 calendar_dates.txt date active tr calendar_dates": "SELECT route_id AS id, count(*) AS seen FROM (SELECT route_id, date FROM (SELECT DISTINCT route_id, service_id FROM tr) JOIN active USING (service_id) LEFT JOIN (SELECT service_id, day(date) AS date, 1 AS hit FROM calendar_dates) e USING (service_id, date) GROUP BY route_id, date HAVING count(DISTINCT service_id) > 1 AND count(hit) > 0) GROUP BY route_id",
    "OPR_024 IAE1 trips.txt trip_id tr": "SELECT route_id AS id, count(*) AS seen FROM tr GROUP BY route_id, service_id HAVING count(*) > max_trips_per_route",
    "OPR_001 MAE3 stop_times.txt departure_time spans tr": "WITH d AS (SELECT DISTINCT route_id, direction_id, service_id, first_dep FROM ran WHERE first_dep IS NOT NULL), g AS (SELECT *, first_dep - lag(first_dep) OVER (PARTITION BY route_id, direction_id, service_id ORDER BY first_dep) AS gap FROM d) SELECT route_id AS id, max(gap) AS seen FROM g WHERE gap IS NOT NULL GROUP BY route_id, direction_id, service_id HAVING max(gap) > max_headway_warning_min * 60 AND try_divide(stddev_pop(gap), avg(gap)) >= 0.25",
    "OPR_003 LAE2 stop_times.txt departure_time spans tr": "WITH g AS (SELECT route_id, direction_id, service_id, first_stop, pattern, first_dep - lag(first_dep) OVER (PARTITION BY route_id, direction_id, service_id, first_stop, pattern ORDER BY first_dep) AS gap FROM (SELECT DISTINCT route_id, direction_id, service_id, first_stop, coalesce(shape_id, last_stop) AS pattern, first_dep FROM ran WHERE first_dep IS NOT NULL)) SELECT route_id AS id, min(gap) AS seen FROM g WHERE gap > 0 GROUP BY route_id, direction_id, service_id, first_stop, pattern HAVING min(gap) < bunching_threshold_min * 60",
    "OPR_005 IAE2 stop_times.txt departure_time spans tr": "WITH g AS (SELECT route_id, direction_id, service_id, route_type, first_dep - lag(first_dep) OVER (PARTITION BY route_id, direction_id, service_id ORDER BY first_dep) AS gap FROM (SELECT DISTINCT route_id, direction_id, service_id, route_type, first_dep FROM ran WHERE first_dep IS NOT NULL)), a AS (SELECT route_id, route_type, avg(gap) AS mean FROM g WHERE gap IS NOT NULL GROUP BY route_id, direction_id, service_id, route_type), m AS (SELECT route_type, median(mean) AS mid, count(*) AS n FROM a GROUP BY route_type HAVING count(*) >= 5), s AS (SELECT a.route_type, median(abs(mean - mid)) * 1.4826 AS mad FROM a JOIN m ON a.route_type = m.route_type GROUP BY a.route_type) SELECT route_id AS id, round(mean, 1) AS seen FROM a JOIN m ON a.route_type = m.route_type JOIN s ON a.route_type = s.route_type WHERE IF(mad >= 30, abs(mean - mid) > headway_outlier_sigma * mad, mean > 2 * mid OR mean < 0.5 * mid)",
    "OPR_014 MAF2 transfers.txt min_transfer_time transfers": "SELECT NULL AS id, round(avg(uint(min_transfer_time)), 1) AS seen FROM transfers WHERE oneof(transfer_type, 2) HAVING avg(uint(min_transfer_time)) > 600",
    # Shapes
    "SHP_005 CSR2 shapes.txt shape_dist_traveled pts": "SELECT shape_id AS id, NULL AS seen, min(line) AS line FROM pts WHERE dist < dist_before GROUP BY shape_id",
    "SHP_006 LQE2 shapes.txt shape_id pts tr": "SELECT shape_id AS id, count(*) AS seen FROM pts WHERE shape_id IN (SELECT shape_id FROM tr) GROUP BY shape_id HAVING count(*) = 1",
    "SHP_010 LQE1 shapes.txt shape_pt_lat pts": "SELECT shape_id AS id, count(*) AS seen FROM pts WHERE abs(lat - lat_before) < 1e-9 AND abs(lon - lon_before) < 1e-9 GROUP BY shape_id",
    "SHP_015 MQE2 shapes.txt shape_pt_sequence pts": "SELECT shape_id AS id, count(*) AS seen FROM pts GROUP BY shape_id HAVING sum(distance) > 1 AND try_divide(count(*), sum(distance) / 10) < 2",
    "SHP_019 MQE2 shapes.txt shape_id pts tr spans": "SELECT shape_id AS id, NULL AS seen FROM (SELECT DISTINCT shape_id FROM pts) JOIN tr USING (shape_id) LEFT JOIN (SELECT trip_id AS t FROM spans) ON t = trip_id GROUP BY shape_id HAVING count(t) = 0",
    "SHP_023 MQE2 shapes.txt shape_dist_traveled pts": "SELECT shape_id AS id, count(*) AS seen FROM pts WHERE abs(dist - dist_before) < 1e-9 AND lat = lat_before AND lon = lon_before GROUP BY shape_id",
    "SHP_025 MQE2 stop_times.txt shape_dist_traveled st tr pts": "WITH m AS (SELECT shape_id, max(dist) AS most FROM pts GROUP BY shape_id), t AS (SELECT trip_id, max(dist) AS most FROM st GROUP BY trip_id) SELECT min(trip_id) AS id, tr.shape_id AS seen FROM t JOIN tr USING (trip_id) JOIN m ON m.shape_id = tr.shape_id WHERE t.most > m.most * 1.001 GROUP BY tr.shape_id",
    "SHP_026 IAE1 shapes.txt shape_id pts": "SELECT shape_id AS id, count(*) AS seen FROM pts GROUP BY shape_id HAVING count(*) > max_shape_points",
    "SHP_028 HSE2 shapes.txt shape_dist_traveled pts": "SELECT shape_id AS id, min(line) AS seen FROM pts WHERE abs(dist - dist_before) < 1e-9 AND distance >= 0.0011 GROUP BY shape_id",
    "SHP_029 IQE2 shapes.txt shape_dist_traveled pts": "SELECT shape_id AS id, min(line) AS seen FROM pts WHERE abs(dist - dist_before) < 1e-9 AND distance > 0 AND distance < 0.0011 GROUP BY shape_id",
    "SHP_030 MQE2 shapes.txt shape_dist_traveled st tr pts": "SELECT shape_id AS id, count(*) AS seen FROM (SELECT DISTINCT shape_id FROM tr WHERE trip_id IN (SELECT trip_id FROM st WHERE dist IS NOT NULL)) JOIN pts USING (shape_id) WHERE dist IS NULL GROUP BY shape_id",
    "SHP_014 IAE3 shapes.txt shape_pt_lat pts places spans tr": "WITH e AS (SELECT shape_id, min_by(lat, seq) AS la, min_by(lon, seq) AS oa, max_by(lat, seq) AS lb, max_by(lon, seq) AS ob FROM pts GROUP BY shape_id), d AS (SELECT tr.shape_id, min(km(la, oa, a.lat, a.lon)) AS first, min(km(lb, ob, b.lat, b.lon)) AS last FROM spans JOIN tr USING (trip_id) JOIN e ON e.shape_id = tr.shape_id JOIN places a ON a.stop_id = first_stop JOIN places b ON b.stop_id = last_stop GROUP BY tr.shape_id) SELECT shape_id AS id, round(greatest(first, last) * 1000, 1) AS seen FROM d WHERE greatest(first, last) * 1000 > stop_far_from_shape_m",
    "GEO_006 HAE3 shapes.txt shape_pt_lat pts": "SELECT shape_id AS id, round(max(distance), 1) AS seen FROM pts WHERE distance > max_shape_jump_km AND distance <= 3 * max_shape_jump_km GROUP BY shape_id",
    "GEO_007 HAE3 shapes.txt shape_pt_lat pts": "SELECT shape_id AS id, round(max(distance), 1) AS seen FROM pts WHERE distance > 3 * max_shape_jump_km GROUP BY shape_id",
    "GEO_020 HQE1 shapes.txt shape_pt_lat pts": "SELECT shape_id AS id, count(*) AS seen FROM pts GROUP BY shape_id HAVING count(*) >= 2 AND min(lat) = max(lat) AND min(lon) = max(lon) AND max(abs(lat)) > 0",
    # Frequencies and transfers
    "FRQ_011 HSR2 frequencies.txt start_time frequencies": "SELECT trip_id AS id, line AS seen FROM (SELECT trip_id, line, sec(start_time) AS a, max(sec(end_time)) OVER (PARTITION BY trip_id ORDER BY sec(start_time), line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy FROM frequencies) WHERE a < busy",
    "TFR_005 MSR1 timeframes.txt start_time timeframes": "SELECT timeframe_group_id AS id, line AS seen FROM (SELECT timeframe_group_id, line, sec(start_time) AS a, max(sec(end_time)) OVER (PARTITION BY timeframe_group_id, service_id ORDER BY sec(start_time), line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy FROM timeframes) WHERE a < busy",
    "TRF_011 IQR2 transfers.txt to_stop_id transfers places": "SELECT from_stop_id AS id, round(km(a.lat, a.lon, b.lat, b.lon) * 1000) AS seen FROM transfers JOIN places a ON a.stop_id = from_stop_id JOIN places b ON b.stop_id = to_stop_id WHERE km(a.lat, a.lon, b.lat, b.lon) > 2",
    "TRF_012 CSR1 transfers.txt from_stop_id transfers": "SELECT from_stop_id AS id, line AS seen FROM (SELECT *, row_number() OVER (PARTITION BY from_stop_id, to_stop_id ORDER BY line) AS n FROM transfers WHERE given(from_stop_id) AND given(to_stop_id) AND blank(from_trip_id) AND blank(to_trip_id) AND blank(from_route_id) AND blank(to_route_id)) WHERE n > 1",
    "TRF_015 HQR2 transfers.txt from_stop_id transfers stops": "SELECT from_stop_id AS id, line AS seen FROM transfers WHERE oneof(transfer_type, 4, 5) AND (from_stop_id IN (SELECT stop_id FROM stops WHERE oneof(location_type, 1)) OR to_stop_id IN (SELECT stop_id FROM stops WHERE oneof(location_type, 1)))",
    "TRF_017 HSR2 transfers.txt from_route_id transfers tr": "SELECT from_trip_id AS id, t.line AS seen FROM transfers t JOIN tr ON t.from_trip_id = tr.trip_id WHERE given(t.from_route_id) AND t.from_route_id <> tr.route_id",
    "TRF_019 MIF2 transfers.txt transfer_type transfers tr": "SELECT t.from_trip_id AS id, NULL AS seen, t.line FROM transfers t JOIN tr a ON t.from_trip_id = a.trip_id JOIN tr b ON t.to_trip_id = b.trip_id WHERE oneof(t.transfer_type, 4, 5) AND a.route_type <> b.route_type",
    "TRF_020 MQR2 transfers.txt min_transfer_time transfers places": "SELECT from_stop_id AS id, round(km(a.lat, a.lon, b.lat, b.lon) * 1000 / uint(min_transfer_time), 2) AS seen FROM transfers JOIN places a ON a.stop_id = from_stop_id JOIN places b ON b.stop_id = to_stop_id WHERE uint(min_transfer_time) > 0 AND km(a.lat, a.lon, b.lat, b.lon) * 1000 / uint(min_transfer_time) > 2.0",
    "TRF_021 CSR1 transfers.txt from_stop_id transfers stops": "SELECT stop_id AS id, location_type AS seen FROM stops WHERE oneof(location_type, 2, 3, 4) AND stop_id IN (SELECT from_stop_id FROM transfers UNION ALL SELECT to_stop_id FROM transfers)",
    "TRF_022 HSE2 transfers.txt to_trip_id transfers tr active": "SELECT t.from_trip_id AS id, min(b.service_id) AS seen FROM transfers t JOIN tr a ON t.to_trip_id = a.trip_id JOIN transfers u ON t.from_trip_id = u.from_trip_id JOIN tr b ON u.to_trip_id = b.trip_id AND a.service_id < b.service_id JOIN active x ON x.service_id = a.service_id JOIN active y ON y.service_id = b.service_id AND x.date = y.date WHERE oneof(t.transfer_type, 4, 5) AND oneof(u.transfer_type, 4, 5) GROUP BY t.from_trip_id",
    "TRF_023 HSE2 transfers.txt from_trip_id transfers tr active": "SELECT t.to_trip_id AS id, min(b.service_id) AS seen FROM transfers t JOIN tr a ON t.from_trip_id = a.trip_id JOIN transfers u ON t.to_trip_id = u.to_trip_id JOIN tr b ON u.from_trip_id = b.trip_id AND a.service_id < b.service_id JOIN active x ON x.service_id = a.service_id JOIN active y ON y.service_id = b.service_id AND x.date = y.date WHERE oneof(t.transfer_type, 4, 5) AND oneof(u.transfer_type, 4, 5) GROUP BY t.to_trip_id",
    "XFL_020 CSR2 transfers.txt to_route_id transfers tr": "SELECT to_trip_id AS id, t.line AS seen FROM transfers t JOIN tr ON t.to_trip_id = tr.trip_id WHERE given(t.to_route_id) AND t.to_route_id <> tr.route_id",
    "XFL_021 HIR2 transfers.txt from_stop_id transfers st": "SELECT from_trip_id AS id, line AS seen FROM transfers t WHERE given(from_trip_id) AND given(from_stop_id) AND NOT EXISTS (SELECT 1 FROM st WHERE st.trip_id = t.from_trip_id AND st.stop_id = t.from_stop_id)",
    # Fares
    "FAR_010 MQF2 fare_rules.txt fare_id fare_rules": "SELECT route_id AS id, count(DISTINCT fare_id) AS seen, min(line) AS line FROM fare_rules GROUP BY route_id, origin_id, destination_id, contains_id HAVING count(DISTINCT fare_id) > 1",
    "FRL_006 IQF1 fare_rules.txt fare_id fare_attributes": "SELECT NULL AS id, count(*) AS seen FROM fare_attributes WHERE (SELECT count(*) FROM fare_rules) = 0 HAVING count(*) > 0",
    "FRL_008 IQF3 fare_rules.txt route_id fare_rules routes": "SELECT NULL AS id, count(*) AS seen FROM routes r WHERE NOT EXISTS (SELECT 1 FROM fare_rules f WHERE f.route_id = r.route_id) AND (SELECT count(*) FROM fare_rules WHERE given(route_id)) > 0 AND (SELECT count(*) FROM fare_rules WHERE blank(route_id)) = 0 HAVING count(*) > 0",
    "FPD_001 CSR1 fare_products.txt fare_product_id fare_products": "SELECT fare_product_id AS id, line AS seen FROM (SELECT *, row_number() OVER (PARTITION BY fare_product_id, coalesce(rider_category_id, ''), coalesce(fare_media_id, '') ORDER BY line) AS n FROM fare_products WHERE given(fare_product_id)) WHERE n > 1",
    "RCT_006 MSE2 fare_products.txt rider_category_id fare_products rider_categories": "SELECT fare_product_id AS id, count(DISTINCT p.rider_category_id) AS seen FROM fare_products p JOIN rider_categories r ON p.rider_category_id = r.rider_category_id GROUP BY fare_product_id HAVING count(DISTINCT p.rider_category_id) > 1 AND count(DISTINCT IF(oneof(is_default_fare_category, 1), p.rider_category_id, NULL)) <> 1",
    "FAR_013 IQL1 fare_attributes.txt price fare_attributes": "SELECT NULL AS id, count(*) AS seen FROM fare_attributes WHERE num(price) IS NOT NULL AND length(regexp_extract(price, '[.]([0-9]*)$', 1)) <> CASE WHEN currency_type IN ('BIF', 'CLP', 'DJF', 'GNF', 'ISK', 'JPY', 'KMF', 'KRW', 'PYG', 'RWF', 'UGX', 'UYI', 'VND', 'VUV', 'XAF', 'XOF', 'XPF') THEN 0 WHEN currency_type IN ('BHD', 'IQD', 'JOD', 'KWD', 'LYD', 'OMR', 'TND') THEN 3 ELSE 2 END HAVING count(*) > 0",
    "FPD_007 LSL1 fare_products.txt amount fare_products": "SELECT NULL AS id, count(*) AS seen FROM fare_products WHERE num(amount) IS NOT NULL AND length(regexp_extract(amount, '[.]([0-9]*)$', 1)) <> CASE WHEN currency IN ('BIF', 'CLP', 'DJF', 'GNF', 'ISK', 'JPY', 'KMF', 'KRW', 'PYG', 'RWF', 'UGX', 'UYI', 'VND', 'VUV', 'XAF', 'XOF', 'XPF') THEN 0 WHEN currency IN ('BHD', 'IQD', 'JOD', 'KWD', 'LYD', 'OMR', 'TND') THEN 3 ELSE 2 END HAVING count(*) > 0",
    "XFL_028 IQF1 fare_media.txt fare_media_type agency fare_products": "SELECT NULL AS id, count(*) AS seen FROM agency WHERE oneof(cemv_support, 1) AND (SELECT count(*) FROM fare_products) > 0 AND (SELECT count(*) FROM fare_media WHERE oneof(fare_media_type, 3)) = 0 HAVING count(*) > 0",
    "XFL_029 IQF1 fare_media.txt fare_media_type routes fare_products": "SELECT NULL AS id, count(*) AS seen FROM routes WHERE oneof(cemv_support, 1) AND (SELECT count(*) FROM fare_products) > 0 AND (SELECT count(*) FROM fare_media WHERE oneof(fare_media_type, 3)) = 0 HAVING count(*) > 0",
    "XFL_030 IQF1 fare_media.txt fare_media_type fare_media agency routes": "SELECT NULL AS id, count(*) AS seen FROM fare_media WHERE oneof(fare_media_type, 3) AND (SELECT count(*) FROM agency WHERE oneof(cemv_support, 1)) + (SELECT count(*) FROM routes WHERE oneof(cemv_support, 1)) = 0 HAVING count(*) > 0",
    "XFL_019 MSF2 routes.txt network_id routes networks": "SELECT NULL AS id, count(*) AS seen FROM routes WHERE given(network_id) HAVING count(*) > 0",
    # Pathways and levels
    "LVL_006 MQE2 stops.txt level_id pathways stops": "SELECT DISTINCT stop_id AS id, NULL AS seen FROM stops WHERE blank(level_id) AND stop_id IN (SELECT from_stop_id FROM pathways WHERE oneof(pathway_mode, 5) UNION ALL SELECT to_stop_id FROM pathways WHERE oneof(pathway_mode, 5))",
    "STP_032 MQF2 stops.txt parent_station pathways stops": "SELECT stop_id AS id, NULL AS seen, line FROM stops WHERE (blank(location_type) OR oneof(location_type, 0)) AND blank(parent_station) AND stop_id IN (SELECT from_stop_id FROM pathways UNION ALL SELECT to_stop_id FROM pathways)",
    "PTH_014 CQE1 pathways.txt to_stop_id pathways places": "SELECT pathway_id AS id, round(km(a.lat, a.lon, b.lat, b.lon) * 1000) AS seen FROM pathways JOIN places a ON a.stop_id = from_stop_id JOIN places b ON b.stop_id = to_stop_id WHERE a.parent_station <> b.parent_station AND a.location_type <> 2 AND b.location_type <> 2 AND km(a.lat, a.lon, b.lat, b.lon) > 0.3",
    "PTH_019 MQE2 pathways.txt from_stop_id pathways stops": "SELECT stop_id AS id, count(*) AS seen FROM stops JOIN (SELECT from_stop_id AS e FROM pathways UNION ALL SELECT to_stop_id FROM pathways) ON e = stop_id WHERE oneof(location_type, 3) GROUP BY stop_id HAVING count(*) = 1",
    "PTH_026 CSR1 pathways.txt from_stop_id pathways stops": "SELECT pathway_id AS id, line AS seen FROM pathways WHERE from_stop_id IN (SELECT stop_id FROM stops WHERE oneof(location_type, 1)) OR to_stop_id IN (SELECT stop_id FROM stops WHERE oneof(location_type, 1))",
    "PTH_030 LSR1 pathways.txt from_stop_id pathways stops": "SELECT pathway_id AS id, line AS seen FROM pathways WHERE from_stop_id IN (SELECT parent_station FROM stops WHERE oneof(location_type, 4) AND given(parent_station)) OR to_stop_id IN (SELECT parent_station FROM stops WHERE oneof(location_type, 4) AND given(parent_station))",
    "PTH_031 CSR1 pathways.txt from_stop_id pathways stops": "SELECT pathway_id AS id, line AS seen FROM pathways WHERE from_stop_id IN (SELECT stop_id FROM stops WHERE oneof(stop_access, 1)) OR to_stop_id IN (SELECT stop_id FROM stops WHERE oneof(stop_access, 1))",
    "PTH_012 HSE3 stops.txt stop_id pathways stops": "SELECT stop_id AS id, NULL AS seen FROM stops WHERE (blank(location_type) OR oneof(location_type, 0)) AND stop_id IN (SELECT from_stop_id FROM pathways UNION ALL SELECT to_stop_id FROM pathways) AND stop_id NOT IN (SELECT node FROM walked)",
    # Translations and attributions
    "TRN_005 CSR1 translations.txt translation translations": "SELECT record_id AS id, line AS seen FROM (SELECT *, row_number() OVER w AS n, first_value(translation) OVER w AS first FROM translations WINDOW w AS (PARTITION BY table_name, field_name, language, coalesce(record_id, ''), coalesce(record_sub_id, ''), coalesce(field_value, '') ORDER BY line)) WHERE n > 1 AND translation <=> first",
    "TRN_006 CSR1 translations.txt translation translations": "SELECT record_id AS id, line AS seen FROM (SELECT *, row_number() OVER w AS n, first_value(translation) OVER w AS first FROM translations WINDOW w AS (PARTITION BY table_name, field_name, language, coalesce(record_id, ''), coalesce(record_sub_id, ''), coalesce(field_value, '') ORDER BY line)) WHERE n > 1 AND NOT translation <=> first",
    "TRN_007 LQR1 translations.txt language translations feed_info": "SELECT NULL AS id, count(*) AS seen FROM translations WHERE lower(language) IN (SELECT lower(feed_lang) FROM feed_info) HAVING count(*) > 0",
    "TRN_004 HSR1 translations.txt record_id translations": "SELECT record_id AS id, line AS seen FROM translations t WHERE given(record_id) AND ((table_name = 'stops' AND NOT EXISTS (SELECT 1 FROM stops x WHERE x.stop_id = t.record_id)) OR (table_name = 'routes' AND NOT EXISTS (SELECT 1 FROM routes x WHERE x.route_id = t.record_id)) OR (table_name = 'trips' AND NOT EXISTS (SELECT 1 FROM trips x WHERE x.trip_id = t.record_id)) OR (table_name = 'agency' AND NOT EXISTS (SELECT 1 FROM agency x WHERE x.agency_id = t.record_id)))",
    "TRN_010 HSR1 translations.txt record_sub_id translations stop_times": "SELECT record_id AS id, line AS seen FROM translations t WHERE table_name = 'stop_times' AND given(record_id) AND given(record_sub_id) AND NOT EXISTS (SELECT 1 FROM stop_times x WHERE x.trip_id = t.record_id AND x.stop_sequence = t.record_sub_id)",
    "XFL_015 CSF1 attributions.txt - attributions": "SELECT NULL AS id, count(*) AS seen FROM attributions a WHERE (given(agency_id) AND NOT EXISTS (SELECT 1 FROM agency x WHERE x.agency_id = a.agency_id)) OR (given(route_id) AND NOT EXISTS (SELECT 1 FROM routes x WHERE x.route_id = a.route_id)) OR (given(trip_id) AND NOT EXISTS (SELECT 1 FROM trips x WHERE x.trip_id = a.trip_id)) HAVING count(*) > 0",
    "XFL_031 CSR2 location_groups.txt location_group_id location_groups stops": "SELECT location_group_id AS id, line AS seen FROM location_groups WHERE location_group_id IN (SELECT stop_id FROM stops)",
    # Networks of routes and stops
    "VAT_001 MAE3 routes.txt route_id tr st": "WITH s AS (SELECT DISTINCT route_id, route_type, stop_id FROM calls WHERE stop_id IS NOT NULL), n AS (SELECT route_id, count(*) AS n FROM s GROUP BY route_id HAVING count(*) >= 5), p AS (SELECT a.route_id AS a, b.route_id AS b, count(*) AS shared FROM s a JOIN s b ON a.stop_id = b.stop_id AND a.route_type = b.route_type AND a.route_id < b.route_id GROUP BY 1, 2) SELECT a AS id, b AS seen FROM p JOIN n x ON x.route_id = a JOIN n y ON y.route_id = b WHERE shared / (x.n + y.n - shared) >= 0.85",
    "VAT_005 MAF3 stops.txt stop_id legs": "WITH c AS (SELECT component, count(*) AS n FROM joined GROUP BY component), t AS (SELECT sum(n) AS total, max(n) AS main FROM c) SELECT NULL AS id, sum(n) AS seen FROM c CROSS JOIN t WHERE total >= 5 AND main >= total / 2 AND n < main AND n <= greatest(total DIV 20, 2) HAVING sum(n) > 0",
    "VAT_006 IAE2 trips.txt route_id tr": "WITH c AS (SELECT route_id, count(*) AS n FROM tr GROUP BY route_id), t AS (SELECT sum(n) AS total, count(*) AS routes FROM c) SELECT route_id AS id, round(n / total, 4) AS seen FROM c CROSS JOIN t WHERE total >= 50 AND routes >= 3 AND n / total >= 0.4",
    "VAT_008 IAE2 trips.txt shape_id tr": "WITH c AS (SELECT shape_id, count(DISTINCT route_id) AS n FROM tr WHERE shape_id IS NOT NULL GROUP BY shape_id), t AS (SELECT count(DISTINCT route_id) AS total FROM tr) SELECT shape_id AS id, n AS seen FROM c CROSS JOIN t WHERE total >= 3 AND n >= 3 AND n > ceil(0.3 * total)",
    "VAT_002 IAE3 stops.txt stop_id tr st near transfers": "WITH r AS (SELECT DISTINCT stop_id, route_id FROM calls), h AS (SELECT stop_id, count(*) AS n FROM r GROUP BY stop_id HAVING count(*) >= 4) SELECT h.stop_id AS id, n AS seen FROM h JOIN places USING (stop_id) WHERE parent_station IS NULL AND h.stop_id NOT IN (SELECT from_stop_id FROM transfers WHERE from_stop_id IS NOT NULL UNION ALL SELECT to_stop_id FROM transfers WHERE to_stop_id IS NOT NULL)",
    "VAT_003 LAE3 stop_times.txt arrival_time spans tr": "WITH d AS (SELECT trip_id, concat_ws('|', route_id, shape_id, first_stop, last_stop, n) AS pattern, last_arr - first_dep AS duration FROM ran WHERE n > 1 AND last_arr >= first_dep), m AS (SELECT pattern, median(duration) AS mid FROM d GROUP BY pattern HAVING count(*) >= 5 AND median(duration) >= 120), s AS (SELECT d.pattern, median(abs(duration - mid)) * 1.4826 AS mad FROM d JOIN m ON d.pattern = m.pattern GROUP BY d.pattern) SELECT trip_id AS id, duration AS seen FROM d JOIN m ON d.pattern = m.pattern JOIN s ON d.pattern = s.pattern WHERE abs(duration - mid) >= 300 AND abs(duration - mid) > duration_outlier_sigma * mad",
    "TRN_016 MSF1 translations.txt field_value translations": "SELECT NULL AS id, count(*) AS seen FROM unmatched HAVING count(*) > 0",
    "XFL_014 MQF1 translations.txt record_id translations": "SELECT NULL AS id, count(DISTINCT t.table_name, t.record_id) AS seen FROM translations t LEFT ANTI JOIN recorded r ON r.table_name = t.table_name AND r.record_id = t.record_id WHERE given(t.record_id) AND t.table_name IN ('agency', 'stops', 'routes', 'trips', 'calendar', 'levels', 'pathways', 'fare_attributes', 'attributions') HAVING count(*) > 0",
    "XFL_016 HSF1 translations.txt table_name translations": "SELECT NULL AS id, count(*) AS seen FROM translations WHERE table_name = 'feed_info' AND (SELECT count(*) FROM feed_info) = 0 HAVING count(*) > 0",
    "TRF_014 HSR2 transfers.txt from_trip_id transfers trips stop_times": "SELECT trip AS id, trip AS seen, line FROM (SELECT line, explode(array(from_trip_id, to_trip_id)) AS trip FROM transfers WHERE oneof(transfer_type, 4, 5)) x WHERE trip IN (SELECT trip_id FROM trips) AND NOT EXISTS (SELECT 1 FROM stop_times s WHERE s.trip_id = x.trip)",
    "RTS_025 IQE1 routes.txt agency_id routes": "SELECT route_id AS id, NULL AS seen FROM routes WHERE blank(agency_id) AND (SELECT count(*) FROM agency) = 0",
    # A headsign that names a stop on the way: not its last one, on no circle, and passed once.
    "TRP_020 IAE1 trips.txt trip_headsign trips stop_times stops": "WITH h AS (SELECT trip_id FROM trips WHERE given(trip_headsign) AND lower(trip_headsign) IN (SELECT lower(stop_name) FROM stops)), s AS (SELECT st.trip_id, st.stop_id, lower(p.stop_name) AS name, IF(blank(p.parent_station), p.stop_id, p.parent_station) AS station, st.seq, st.line FROM st JOIN stops p ON p.stop_id = st.stop_id WHERE st.trip_id IN (SELECT trip_id FROM h)), o AS (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY seq, line) AS i, count(*) OVER (PARTITION BY trip_id) AS n, first_value(station) OVER w AS first, last_value(station) OVER w AS last, coalesce(lag(station) OVER (PARTITION BY trip_id ORDER BY seq, line) <> station, true) AS arrives FROM s WINDOW w AS (PARTITION BY trip_id ORDER BY seq, line ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), v AS (SELECT *, count_if(arrives) OVER (PARTITION BY trip_id, station) AS visits FROM o) SELECT v.trip_id AS id, v.stop_id AS seen FROM v JOIN trips t ON t.trip_id = v.trip_id WHERE given(t.trip_headsign) AND v.name = lower(t.trip_headsign) AND i > 1 AND i < n AND first <> last AND visits = 1",
    # The nearest station, by distance and id; two stations one of which has a stop of the other upon it.
    "STP_046 LQE10 stops.txt parent_station stations_near places": "SELECT stop_id AS id, min_by(station, struct(metres, station)) AS seen FROM stations_near WHERE parent_station IS NULL GROUP BY stop_id",
    "STP_047 LQE10 stops.txt parent_station stations_near places": "SELECT min_by(parent_station, line) AS id, min_by(station, line) AS seen FROM (SELECT n.*, km(a.lat, a.lon, b.lat, b.lon) * 1000 AS apart FROM stations_near n JOIN places a ON a.stop_id = n.parent_station AND a.location_type = 1 JOIN places b ON b.stop_id = n.station WHERE n.station <> n.parent_station AND NOT (abs(a.lat) < 0.1 AND abs(a.lon) < 0.1)) WHERE apart >= stop_too_close_m AND apart <= 150 GROUP BY least(parent_station, station), greatest(parent_station, station)",
}
  # fmt: skip
