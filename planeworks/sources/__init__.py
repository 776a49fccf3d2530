"""Tables, planes and file formats that the operators read and write."""
