"""Fixed values of elements. Masses and increments keep few decimals so that integer sums stay exact."""

# Symbols by atomic number that bracket atoms may name in the compat reading.
SYMBOLS = {
    1: "H", 2: "He", 3: "Li", 4: "Be", 5: "B", 6: "C", 7: "N", 8: "O", 9: "F", 10: "Ne", 11: "Na", 12: "Mg", 13: "Al", 14: "Si", 15: "P",
    16: "S", 17: "Cl", 18: "Ar", 19: "K", 20: "Ca", 26: "Fe", 27: "Co", 28: "Ni", 29: "Cu", 30: "Zn", 35: "Br", 36: "Kr", 47: "Ag", 53: "I", 54: "Xe",
}
NUMBERS = {s.lower(): z for z, s in SYMBOLS.items()}
# Atomic masses in thousandths.
MASS_MILLI = {1: 1008, 5: 10810, 6: 12011, 7: 14007, 8: 15999, 9: 18998, 15: 30974, 16: 32060, 17: 35450, 35: 79904, 53: 126900}
MASS_MILLI_GRAPH = MASS_MILLI | {14: 28085}
# Additive logP increments in hundredths.
LOGP_CENTI = {6: 35, 7: -103, 8: -74, 9: 14, 16: 3, 17: 60, 35: 88}
# Standard valences.
VALENCE = {1: 1, 5: 3, 6: 4, 7: 3, 8: 2, 9: 1, 14: 4, 15: 3, 16: 2, 17: 1, 35: 1, 53: 1}
# The allowed valences, lowest first, of the full reading.
VALENCES = {1: (1,), 5: (3,), 6: (4,), 7: (3, 5), 8: (2,), 9: (1,), 14: (4,), 15: (3, 5), 16: (2, 4, 6), 17: (1,), 34: (2, 4, 6), 35: (1,), 53: (1,)}
# Standard atomic weights for molecular weights with hydrogens.
WEIGHT = {
    1: 1.008, 2: 4.003, 3: 6.941, 4: 9.012, 5: 10.812, 6: 12.011, 7: 14.007, 8: 15.999, 9: 18.998, 10: 20.18, 11: 22.99, 12: 24.305, 13: 26.982, 14: 28.086,
    15: 30.974, 16: 32.067, 17: 35.453, 18: 39.948, 19: 39.098, 20: 40.078, 26: 55.845, 27: 58.933, 28: 58.693, 29: 63.546, 30: 65.39, 34: 78.96, 35: 79.904,
    36: 83.8, 47: 107.868, 53: 126.904, 54: 131.29,
}
MORE_SYMBOLS = {34: "Se"}
