"""Column functions on short DNA: composition, masks, thermodynamics and structures."""
