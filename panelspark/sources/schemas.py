"""Declared schemas of the inputs; nothing is inferred at read time."""

POSTS = """
  id BIGINT, text STRING, created_at STRING, lang STRING,
  user STRUCT<id: BIGINT>,
  extended_tweet STRUCT<full_text: STRING>,
  retweeted_status STRUCT<id: BIGINT, text: STRING, extended_tweet: STRUCT<full_text: STRING>>,
  limit STRUCT<track: BIGINT>
"""
PLACES = "places MAP<STRING, ARRAY<BIGINT>>"
CODES = "geo_level STRING, area_name STRING, state_code_fips INT, county_code_fips INT, fips_code BIGINT"
VACCINATIONS = "Date STRING, FIPS STRING, Series_Complete_Pop_Pct DOUBLE, Series_Complete_Yes BIGINT"
POPULATION = "STATE STRING, COUNTY STRING, POPESTIMATE2020 STRING"
ELECTION = "county_fips INT, per_dem DOUBLE, per_gop DOUBLE"
RURAL_URBAN = "FIPS INT, RUCC_2013 INT"
GINI = "GEO_ID STRING, B19083_001E STRING"
ANSWERS = "text STRING, answer STRING"
RATERS = "tweetid BIGINT, text STRING, rating1 INT, rating2 INT, rating3 INT"
DISTANCES = "county1 INT, county2 INT, mi_to_county DOUBLE"
INDEX = "user_loc INT, fr_loc INT, scaled_sci DOUBLE"
