"""Schemas of the input tables; optional variables are nullable."""

from __future__ import annotations

SNAPSHOTS = "event_id bigint, t timestamp_ntz, sat int, y int, x int, AOD double, AE1 double, DQF int, AE_DQF int, n_flags int"
HOURLY = "t timestamp_ntz, y int, x int, AOD double, AOD470 double, n_snapshots bigint"
DAILY = "time date, y int, x int, AOD double, AOD470 double, AE double, n_snapshots bigint"

# Column titles of the published monitor files.
MONITOR_CSV = ("`Date Local` date, Latitude double, Longitude double, `Arithmetic Mean` double, "
               "`Local Site Name` string, `State Name` string, POC int")
MONITOR_NAMES = {"Date Local": "time", "Latitude": "latitude", "Longitude": "longitude", "Arithmetic Mean": "value",
                 "Local Site Name": "site_name", "State Name": "state_name"}

# Column titles of the sun-photometer files.
PHOTOMETER_CSV = ("`AERONET_Site_Name` string, `Site_Latitude(Degrees)` double, `Site_Longitude(Degrees)` double, "
                  "`Date(dd:mm:yyyy)` string, `Time(hh:mm:ss)` string, `AOD_675nm` double, "
                  "`440-675_Angstrom_Exponent` double")
PHOTOMETER_NAMES = {"AERONET_Site_Name": "site", "Site_Latitude(Degrees)": "lat", "Site_Longitude(Degrees)": "lon",
                    "Date(dd:mm:yyyy)": "day", "Time(hh:mm:ss)": "clock", "AOD_675nm": "AOD_675",
                    "440-675_Angstrom_Exponent": "AE"}

# coordinates stay text until the type of the geometry says how deep they are nested
GEOJSON = ("type string, features array<struct<type: string, properties: map<string, string>, "
           "geometry: struct<type: string, coordinates: string>>>")
FEATURE = "type string, properties map<string, string>, geometry struct<type: string, coordinates: string>"
RINGS = {"Polygon": "array<array<array<double>>>", "MultiPolygon": "array<array<array<array<double>>>>"}
