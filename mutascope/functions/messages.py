"""Error texts, shared by the operators and the oracle SQL."""

EMPTY = "no residues given"
LONG = " residues; at most {} are accepted"          # after the length
LETTERS = "unknown letters: "                        # then the letters
TOP_N = ("top_n ", " is not in 1..{}")               # around the value
BELOW = "positions start at 1, not "                 # then the positions
ABOVE = ("beyond the last residue (", "): ")         # around the length, then the positions
BAD_RANGE, BAD_POSITION = "cannot read the range ", "cannot read the position "  # then the token
NO_ITEMS = "the batch is empty"
MANY_ITEMS = " items; at most {} fit a batch"        # after the number
