"""Tables that are written in versions, and the stores of the domain over them."""
