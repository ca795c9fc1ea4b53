"""DataFrame -> DataFrame operators of the labelling and evaluation workflow."""
