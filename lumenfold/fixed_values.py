"""Constants that decide results and are meant to be read as plain tables."""

# region: (energy_min, energy_max, typical_be, analysis_min, analysis_max, intensity_mask_threshold, focus_clusters)
REGION_DEFINITIONS = {
    "C1s": (280.0, 295.0, 284.8, 282.0, 292.0, 5.0, None),
    "O1s": (525.0, 540.0, 532.0, 528.0, 538.0, None, None),
    "Si2p": (96.0, 108.0, 99.3, 98.0, 106.0, None, None),
    "N1s": (395.0, 410.0, 399.8, 397.0, 407.0, None, None),
    "F1s": (680.0, 695.0, 688.0, 683.0, 690.0, 10.0, [2]),
    "Li1s": (50.0, 60.0, 54.7, 52.0, 60.0, None, None),
    "P2p": (128.0, 140.0, 133.0, 130.0, 138.0, None, None),
    "S2p": (155.0, 175.0, 164.0, 160.0, 170.0, None, None),
    "Cl2p": (195.0, 210.0, 200.0, 197.0, 207.0, None, None),
    "Al2p": (70.0, 80.0, 74.0, 72.0, 78.0, None, None),
    "Ag3d": (365.0, 380.0, 368.2, 367.0, 377.0, None, None),
    "Ir4f": (58.0, 70.0, 61.2, 59.0, 74.0, None, None),
    "Ti2p": (450.0, 470.0, 458.5, 455.0, 468.0, None, None),
}

# region: (rsf, corrected_rsf)
SENSITIVITY_FACTORS = {
    "Li1s": (0.028, 1.258),
    "C1s": (0.314, 6.631),
    "N1s": (0.499, 22.814),
    "O1s": (0.733, 16.007),
    "F1s": (1.000, 22.267),
    "Si2p": (0.368, 19.281),
    "P2p": (0.525, 12.497),
    "S2p": (0.717, 36.956),
    "Ni2p": (3.702, 187.894),
    "Ir4f": (5.484, 285.853),
}

# metal line: binding energy in eV
METALLIC_REFERENCES = {"Au4f": 83.96, "Ag3d": 368.21, "Cu2p": 932.62, "Si2p": 99.30, "Ir4f": 60.83}

PHOTON_ENERGY_EV = 1486.6
CARBON_TARGET_EV = 284.8
MAX_SHIFT_EV = 5.0
TOUGAARD_B = 2866.0
TOUGAARD_C = 1643.0
