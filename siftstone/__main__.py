from siftstone.plans.cli import main

main()
