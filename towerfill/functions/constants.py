"""Fixed values that must equal the reference's for the same results.

They are stated plainly, in the reference's order.
"""

# --- fixed values -----------------------------------------------------------------

# Time-column names tried by the general layout, in priority order.
TIME_COLUMNS = [
    "datetime", "timestamp", "date", "time", "date_time", "datetime_utc", "date_local", "recorded_at",
    "observation_time", "sample_time", "created_at", "updated_at", "event_time", "start_time", "end_time",
    "log_time", "measurement_time", "collection_time", "transaction_time", "time_stamp", "time_utc",
    "utc_time", "utc_datetime", "local_time", "local_datetime", "time_local", "time_recorded",
]

# Features of the time-only (TIME) model.
TIME_FEATURES = [
    "hour", "day", "month", "year", "dayofyear", "weekday", "is_weekend", "hour_sin", "hour_cos",
    "dayofyear_sin", "dayofyear_cos", "month_sin", "month_cos", "hour_decimal", "season", "season_0",
    "season_1", "season_2", "season_3", "is_morning", "is_afternoon", "is_evening", "is_night",
]

# Column of the EC-tower layout that identifies it.
EC_TOWER_CO2 = "upward mole flux of carbon dioxide in air (1e-6 mol s-1 m-2) (co2_flux)"

# Long EC-tower names -> short names (the wind pair is renamed to wind_dir, which the
# met features read; two pairs map to one name and are merged with coalesce in this order).
RENAME_MAP = [
    ("date", "date"),
    ("time (UTC)", "time"),
    ("upward sensible heat flux in air (W m-2) (H)", "sensible_heat_flux"),
    ("quality flag upward sensible heat flux in air (cat) (qc_H)", "sensible_heat_flux_qc"),
    ("upward latent heat flux in air (W m-2) (LE)", "latent_heat_flux"),
    ("quality flag upward latent heat flux in air (cat) (qc_LE)", "latent_heat_flux_qc"),
    ("H2O signal strength infrared gasanalyser  (1) (H2O_sig_strgth_mean)", "H2O_signal_strength"),
    ("upward mole flux of carbon dioxide in air (1e-6 mol s-1 m-2) (co2_flux)", "co2_flux"),
    ("quality flag upward mole flux of carbon dioxide in air (cat) (qc_co2_flux)", "co2_flux_qc"),
    ("CO2 signal strength infrared gasanalyser (1) (CO2_sig_strgth_mean)", "CO2_signal_strength"),
    ("wind speed (m s-1) (wind_speed)", "wind_speed"),
    ("wind from direction (degree) (wind_dir)", "wind_dir"),
    ("friction velocity (m s-1) (u*)", "friction_velocity"),
    ("obukhov length (m) (L)", "obukhov_length"),
    ("monin-obukhov stability parameter (1) ((z-d)/L)", "stability_parameter"),
    ("bowen ratio (1) (bowen_ratio)", "bowen_ratio"),
    ("northward wind (m2 s-2) (v_var)", "northward_wind"),
    ("w wind component (m s-1) (w_unrot)", "w_wind_component"),
    ("air temperature (degree_C) (T_40m_Avg)", "air_temperature"),
    ("air temperature (degree_C) (T_1000cm_Avg)", "air_temperature"),
    ("relative humidity (%) (RH_40m_Avg)", "relative_humidity"),
    ("relative humidity (%) (RH_1000cm_Avg)", "relative_humidity"),
    ("downwelling shortwave flux in air (W m-2) (SPN_TOTAL_Avg)", "downwelling_shortwave_flux_total"),
    ("diffuse downwelling shortwave flux in air (W m-2) (SPN_DIFFUSE_Avg)", "downwelling_shortwave_flux_diffuse"),
    ("downwelling shortwave flux in air (W m-2) (Rs_downwell_Avg)", "downwelling_shortwave_flux"),
    ("downwelling longwave flux in air (W m-2) (Rl_downwell_Avg)", "downwelling_longwave_flux"),
    ("upwelling shortwave flux in air (W m-2) (Rs_upwell_Avg)", "upwelling_shortwave_flux"),
    ("upwelling longwave flux in air (W m-2) (Rl_upwell_Avg)", "upwelling_longwave_flux"),
    ("surface net downward radiative flux (W m-2)", "net_radiative_flux"),
]

MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
DAYS_IN_MONTH = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]

WIND_SECTORS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]

# Obukhov-length bin edges (right-closed) with their class labels and indices.
STABILITY_EDGES = [-200, -100, -50, 0, 50, 100, 200]
STABILITY_CLASSES = ["very unstable", "unstable", "slightly unstable", "neutral unstable",
                     "neutral stable", "slightly stable", "stable", "very stable"]
STABILITY_INDEX = [-3, -2, -1, -0.5, 0.5, 1, 2, 3]

# Shift, rolling and sampling defaults.
SHIFT_PERIODS = [3, 4, 5, 6, 24, 168]
ROLLING_WINDOWS = [3, 6, 12]
ROLLING_STATS = ["mean", "std"]

# Physical constants of the VPD / potential-ET formulas.
SVP_A, SVP_B, SVP_C = 0.611, 17.502, 240.97
LAMBDA_V, CP_AIR, RHO_AIR, GAMMA_PSY = 2.45e6, 1013, 1.225, 0.067
SURFACE_RESISTANCE = 70
VON_KARMAN = 0.41
ROUGHNESS = 0.01
W_TO_MJ_DAY = 0.0864

# umol CO2 m-2 s-1 -> "gC m-2 day-1" as the reference computes it (12.01e-6 * 86400 / 1000).
CARBON_FACTOR = 12.01 * 1e-6 * 86400 / 1000

# Sentinel for missing values in FLUXNET-style files.
MISSING_SENTINEL = -9999

# Feature auto-selection: names containing any of these are not features.
EXCLUDE_PATTERNS = ["date", "time", "_qc", "flag", "datetime", "month"]
# --- end of fixed values ------------------------------------------------------------
