"""Work lists (what is still to do) and the stage jobs composed of the operators."""
