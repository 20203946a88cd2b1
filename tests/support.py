DATA = "/root/testdata"
